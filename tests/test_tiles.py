"""Tile-wise flow against plain walks, with tiles small enough that rivers cross many."""

import numpy as np
import pytest

from thalweg.operators import flow, tiles


def grid(seed, rows=23, cols=31):
    """Every cell drains to a lower neighbour, or is a sink: heights are random."""
    rng = np.random.default_rng(seed)
    z = rng.random((rows, cols)) + np.add.outer(np.arange(rows)[::-1], np.arange(cols)) * 0.2
    dst = np.arange(rows * cols).reshape(rows, cols)
    for r in range(rows):
        for c in range(cols):
            near = [(z[i, j], i * cols + j) for i in range(max(r - 1, 0), min(r + 2, rows)) for j in range(max(c - 1, 0), min(c + 2, cols))]
            dst[r, c] = min(near)[1]
    return dst.ravel(), cols


@pytest.mark.parametrize("seed,side", [(1, 4), (2, 7), (3, 64)])
def test_accumulation_and_labels(spark, seed, side):
    dst, cols = grid(seed)
    cells = spark.createDataFrame([(i, int(d)) for i, d in enumerate(dst)], "src long, dst long")
    acc = np.zeros(len(dst))
    for i in range(len(dst)):
        at = i
        while True:
            acc[at] += 1
            if dst[at] == at:
                break
            at = dst[at]
    got = {r["src"]: r["facc"] for r in tiles.accumulation(cells, cols, side).collect()}
    assert got == dict(enumerate(acc))
    seeds = [(i, 1 + i % 5) for i in range(0, len(dst), 17)] + [(0, 9), (10**6, 3)]
    best = {}
    for node, label in seeds:
        best[node] = max(best.get(node, 0), label)
    want = {}
    for i in range(len(dst)):
        at = i
        while at not in best and dst[at] != at:
            at = dst[at]
        want[i] = best.get(at, 0)
    found = tiles.labelled(cells, spark.createDataFrame(seeds, "node long, label long"), cols, side)
    assert {r["node"]: r["label"] for r in found.collect()} == want


def test_cycles(spark):
    cells = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 3)], "src long, dst long")
    with pytest.raises(Exception, match="cycles"):
        tiles.accumulation(cells, 4).collect()
    with pytest.raises(Exception, match="cycles"):
        tiles.accumulation(cells, 4, 1).collect()
    with pytest.raises(ValueError, match="cycles"):
        flow.accumulation(cells).collect()
    found = tiles.labelled(cells, spark.createDataFrame([(3, 5)], "node long, label long"), 4)
    assert {r["node"]: r["label"] for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 5}


@pytest.mark.parametrize("seed,side,lost", [(4, 4, "few"), (5, 7, "few"), (6, 5, "tile"), (7, 64, "last")])
def test_grids_with_gaps(spark, seed, side, lost):
    """Cells that are not there, and whole tiles of them, as in tables without their no-data cells."""
    dst, cols = grid(seed)
    rng = np.random.default_rng(seed)
    gone = {"few": rng.random(len(dst)) < 0.15, "tile": (np.arange(len(dst)) // cols // side == 1) & (np.arange(len(dst)) % cols // side == 2), "last": np.arange(len(dst)) >= len(dst) - 3}[lost]
    cells = spark.createDataFrame([(i, int(d)) for i, d in enumerate(dst) if not gone[i]], "src long, dst long")
    want = {r["src"]: r["facc"] for r in flow.accumulation(cells).collect()}
    assert {r["src"]: r["facc"] for r in tiles.accumulation(cells, cols, side).collect()} == want
    seeds = spark.createDataFrame([(i, 1 + i % 5) for i in range(0, len(dst), 13)], "node long, label long")
    there = seeds.join(cells.selectExpr("src as node"), "node", "left_semi")
    labels = {r["node"]: r["label"] for r in flow.labelled(cells, there).collect()}
    assert {r["node"]: r["label"] for r in tiles.labelled(cells, seeds, cols, side).collect()} == labels


def test_gap_by_hand(spark):
    """A 4 x 4 grid that drains south without the cell in row 2 and column 1."""
    cells = spark.createDataFrame([(i, min(i + 4, i % 4 + 12)) for i in range(16) if i != 9], "src long, dst long")
    for side in (2, 4):
        got = {r["src"]: r["facc"] for r in tiles.accumulation(cells, 4, side).collect()}
        assert got[10] == 3 and got[14] == 4 and got[13] == 1 and got[5] == 2


@pytest.mark.parametrize("side", [3, 8, 64])
def test_path(spark, side):
    dst, cols = grid(9)
    rng = np.random.default_rng(9)
    gone = rng.random(len(dst)) < 0.03
    cells = spark.createDataFrame([(i, int(d)) for i, d in enumerate(dst) if not gone[i]], "src long, dst long")
    far = lambda i: 0 if gone[i] else 1 + (0 if dst[i] == i else far(dst[i]))
    start = max((i for i in range(len(dst)) if not gone[i]), key=far)
    want, at = {}, start
    while at not in want and not gone[at]:
        want[at] = len(want)
        at = int(dst[at])
    assert {r["node"]: r["step"] for r in tiles.path(cells, start, cols, side).collect()} == want and len(want) > 5
    assert tiles.path(cells, 10**6, cols, side).count() == 0


def test_path_that_meets_itself(spark):
    cells = spark.createDataFrame([(0, 1), (1, 2), (2, 6), (6, 5), (5, 1), (9, 9)], "src long, dst long")
    for side in (1, 2, 8):
        assert {r["node"]: r["step"] for r in tiles.path(cells, 0, 4, side).collect()} == {0: 0, 1: 1, 2: 2, 6: 3, 5: 4}
    assert [tuple(r) for r in tiles.path(cells, 9, 4, 2).collect()] == [(9, 0)]
