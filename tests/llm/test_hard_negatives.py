import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import catalog
from thalweg.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=10):
    """By all pairs; rows in their order, which settles what ids leave open."""
    fit = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) >= hn.LARGEST for x in v):
            continue
        fit.append((k, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, i, label, v in fit:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in fit if m != k))
        for s, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            inside = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside[:negatives])]
    return sorted(out)


def check(spark, rows, **how):
    found = hn.mine(spark.createDataFrame(rows, SCHEMA), **how)
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows, **how)
    return got


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, width)) * np.linspace(spread, 0.1, width)
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 4)) if rng.random() < 0.6 else 1  # one label holds over a half
        rows.append((i, [float(x) for x in (middle[label] + rng.normal(size=width) * 0.4).astype(np.float32)], label))
    return rows


@pytest.mark.parametrize("width", [1, 3, 40])
def test_against_all_pairs(spark, width):
    assert check(spark, vectors(400, width, width), every=20)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 7)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "STEPS", (2, 5))
    rng = random.Random(1)
    rows = vectors(150, 12, 5)
    rows += [(1000 + i, rows[rng.randrange(20)][1], rng.randrange(4)) for i in range(60)]  # equal scores
    check(spark, rows, every=10, positives=3, negatives=4)


def test_hard_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [1.0, 2.0], 2), (200, None, 1), (300, [1.0, None], 1), (400, [nan, 1.0], 1), (500, [inf, 1.0], 1), (600, [1e30, 1.0], 1),
        (700, [], 1), (800, [3.0], 2), (900, [-1.0, -2.0], 1), (1, [0.5, 1.0], 2), (2, [0.4, 0.9], 2), (3, [0.0, 0.0], 2), (4, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (5, [-0.001, 0.3], 3),
        (6, [200000.0, -200000.0], 2), (7, [199999.0, -200000.0], 2), (1000, [200000.0, -1.0], 2), (8, [100000.0, 0.0], 3),
    ]
    check(spark, rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame(vectors(30, 3, 2), SCHEMA).withColumn("v", F.lit("x")).withColumn("uid", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("score", F.lit(1))
    assert hn.mine(df, every=10).count() == len(brute(vectors(30, 3, 2), every=10))
    assert hn.mine(df.limit(0)).count() == 0
    assert hn.mine(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_bounds_discard_most_rows_and_keep_every_listed_one():
    """With a few strong components nearly all rows go by the leading products; none that belongs to a list does."""
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(600, 64)) * np.geomspace(300, 0.5, 64)).astype(np.int32)
    _, axes = np.linalg.eigh(v.T.astype(float) @ v)
    axes = axes[:, ::-1]
    q = v @ axes
    tail = np.sqrt(np.cumsum((q * q)[:, ::-1], axis=1))[:, ::-1]
    block = hn.Block.__new__(hn.Block)
    block.v, block.q, block.rest = v, q[:, :16], np.stack([tail[:, 8], tail[:, 16], tail[:, 0]], axis=1)
    true = v.astype(np.int64) @ v.T.astype(np.int64)
    low = np.sort(true, axis=1)[:, -10].astype(float)
    i, j = hn.survivors(block, block, np.ones(true.shape, bool), low, np.full(600, np.inf), (8, 16), 1e-12)
    kept = set(zip(i.tolist(), j.tolist()))
    assert kept >= set(zip(*(x.tolist() for x in np.nonzero(true >= low[:, None]))))
    assert len(kept) < 0.1 * true.size
    assert (hn.products(block, block, i, j) == true[i, j]).all()


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = sorted(db.execute(hn.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in catalog.op12_hard_negatives(spark, folder).collect()) == want and want
