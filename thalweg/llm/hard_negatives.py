"""Hard negatives by inner product: exact best lists behind bounds from the leading principal components.

Vectors are integers (components times ``SCALE``, rounded down). An orthogonal rotation to the
principal axes of all rows keeps their inner products and puts most of their length into the leading
components. For an anchor and a row the products of the leading components are summed up step by
step; what is left is at most the product of the two residual lengths, plus a slack for rounding. A
row whose bound can no longer enter an anchor's list is discarded, and only survivors are scored in
integers: ranks never rest on rounded numbers.

Rows stand in blocks of ``ROWS``, and anchors in blocks of ``ANCHORS``. Blocks of rows are dealt to
shards, each anchor block goes to every shard and meets the shard's blocks one after the other, so a
task holds one block of each and a list for each anchor, and the lists of a shard are merged with
those of the other shards. No label or vector gathers rows in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SCALE = 256
#: Components from here on count as not finite: their products need not fit a long.
LARGEST = float(1 << 18)
ROWS, ANCHORS = 4096, 512
#: Leading components after which rows are discarded.
STEPS = (8, 16, 32)
LABELS = 10

_PACKED = "block long, uid binary, vec_id binary, label binary, v binary, q binary, rest binary"


def usable(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, v of the rows that take part: no null in id, label or vector, no component that is null, NaN or out of range."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"), v.alias("v"))
    fit = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fit).select("vec_id", "label", "v")


def with_planted_labels(vectors: DataFrame, id_col: str, label: str, every: int = 7) -> DataFrame:
    """Every ``every``-th id's label moves on by one of ``LABELS``."""
    moved = F.when(F.col(id_col) % every == 0, (F.col(label) + 1) % LABELS).otherwise(F.col(label))
    return vectors.withColumn(label, moved)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int32)  # LARGEST times SCALE fits
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def rotation(rows: DataFrame, width: int) -> tuple[np.ndarray, float]:
    """(principal axes of all rows as columns, the most important first; how far from orthogonal they are, rounding included).

    The second moments are summed over all rows by Spark: ``width`` squared numbers come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b["v"], width).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"at": np.arange(width * width), "s": total.ravel()})

    sums = rows.select("v").mapInPandas(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    moment = np.zeros(width * width)
    for r in sums:
        moment[r["at"]] = r["s"]
    _, axes = np.linalg.eigh(moment.reshape(width, width))
    axes = np.ascontiguousarray(axes[:, ::-1])
    departure = float(np.linalg.norm(axes.T @ axes - np.eye(width)))
    return axes, departure + 64 * (width + 1) * np.finfo(np.float64).eps


def packed(rows: DataFrame, axes: np.ndarray, size: int, steps: tuple[int, ...]) -> DataFrame:
    """Blocks of up to ``size`` rows as arrays: uid, vec_id, label, v (integers), q (leading rotated components), rest.

    ``rest`` has a row's residual length after each of ``steps``, and its whole length.
    """
    width, lead = axes.shape[0], steps[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), size):
                b = whole.iloc[at : at + size]
                v = _matrix(b["v"], width)
                q = v.astype(np.float64) @ axes
                # From the far end, so that small residuals keep their digits.
                tail = np.sqrt(np.cumsum((q * q)[:, ::-1], axis=1))[:, ::-1]
                tail = np.concatenate([tail, np.zeros((len(b), 1))], axis=1)
                rest = np.concatenate([tail[:, list(steps)], tail[:, :1]], axis=1)
                uid = b["uid"].to_numpy(np.int64)
                yield pd.DataFrame([(
                    int(uid[0]), uid.tobytes(), b["vec_id"].to_numpy(np.int64).tobytes(), b["label"].to_numpy(np.int64).tobytes(),
                    v.tobytes(), np.ascontiguousarray(q[:, :lead]).tobytes(), rest.tobytes(),
                )], columns=[c.split()[0] for c in _PACKED.split(", ")])

    return rows.select("uid", "vec_id", "label", "v").mapInPandas(run, _PACKED)


class Block:
    """A packed block's arrays."""

    def __init__(self, row, prefix: str, width: int, n_steps: int):
        get = lambda name, kind: np.frombuffer(getattr(row, prefix + name), kind)
        self.uid, self.vec_id, self.label = (get(n, np.int64) for n in ("uid", "vec_id", "label"))
        n = len(self.uid)
        self.v = get("v", np.int32).reshape(n, width)
        self.q = get("q", np.float64).reshape(n, -1)
        self.rest = get("rest", np.float64).reshape(n, n_steps + 1)


def survivors(a: Block, b: Block, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, steps: tuple[int, ...], slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of the allowed pairs whose product may lie between ``low`` and ``high`` of the anchor.

    Rows that no anchor can take any more leave the sums of later steps.
    """
    columns = np.flatnonzero(allowed.any(axis=0))
    allowed = allowed[:, columns]
    partial, done = np.zeros(allowed.shape), 0
    for k, step in enumerate(steps):
        partial += a.q[:, done:step] @ b.q[columns, done:step].T
        done = step
        reach = np.outer(a.rest[:, k], b.rest[columns, k]) + slack * np.outer(a.rest[:, -1], b.rest[columns, -1]) + 1e-6
        allowed &= (partial + reach >= low[:, None]) & (partial - reach <= high[:, None])
        keep = allowed.any(axis=0)
        if not keep.all():
            columns, allowed, partial = columns[keep], allowed[:, keep], partial[:, keep]
    i, j = np.nonzero(allowed)
    return i, columns[j]


def products(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("nd,nd->n", a.v[i[part]], b.v[j[part]], dtype=np.int64)
    return out


class Best:
    """The first ``n`` (score down, vec_id, uid) of each list, as rows sorted by list and place."""

    def __init__(self, lists: int, n: int):
        self.lists, self.n = lists, n
        self.rows = np.zeros((0, 4), np.int64)  # list, score, vec_id, uid

    def add(self, rows: np.ndarray) -> None:
        both = np.concatenate([self.rows, rows])
        both = both[np.lexsort((both[:, 3], both[:, 2], -both[:, 1], both[:, 0]))]
        first = np.searchsorted(both[:, 0], np.arange(self.lists))
        self.rows = both[np.arange(len(both)) - first[both[:, 0]] < self.n]

    def worst(self) -> np.ndarray:
        """The score that a row must reach to enter each list: the least integer while a list is not full."""
        out = np.full(self.lists, np.iinfo(np.int64).min)
        ends = np.searchsorted(self.rows[:, 0], np.arange(self.lists), side="right")
        full = np.bincount(self.rows[:, 0], minlength=self.lists) >= self.n
        out[full] = self.rows[ends[full] - 1, 1]
        return out


def _met(blocks: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Each anchor block with every block of rows: anchors are copied to the shards that blocks of rows are dealt to."""
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    copied = anchors.withColumnsRenamed({c: f"a_{c}" for c in anchors.columns}).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    # The anchors' side is streamed and the shard's rows are buffered, so an anchor block's rows come together.
    return copied.hint("merge").join(dealt, "shard").drop("shard")


def _float(bound: np.ndarray) -> np.ndarray:
    return np.where(bound == np.iinfo(np.int64).min, -np.inf, bound.astype(np.float64))


def nearest_of_label(blocks: DataFrame, anchors: DataFrame, shards: int, width: int, n: int, steps: tuple[int, ...], slack: float) -> DataFrame:
    """anchor (uid), anchor_id, place, positive (uid), positive_id, score: the first ``n`` other rows of the anchor's label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, a, best = None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.a_block != held:
                    if best is not None:
                        yield emit(a, best)
                    held, a = row.a_block, Block(row, "a_", width, len(steps))
                    best = Best(len(a.uid), n)
                b = Block(row, "", width, len(steps))
                allowed = (a.label[:, None] == b.label[None, :]) & (a.uid[:, None] != b.uid[None, :])
                i, j = survivors(a, b, allowed, _float(best.worst()), np.full(len(a.uid), np.inf), steps, slack)
                s = products(a, b, i, j)
                fit = s >= best.worst()[i]
                i, j, s = i[fit], j[fit], s[fit]
                best.add(np.stack([i, s, b.vec_id[j], b.uid[j]], axis=1))
        if best is not None:
            yield emit(a, best)

    def emit(a: Block, best: Best) -> pd.DataFrame:
        r = best.rows
        return pd.DataFrame({"anchor": a.uid[r[:, 0]], "anchor_id": a.vec_id[r[:, 0]], "score": r[:, 1], "positive_id": r[:, 2], "positive": r[:, 3]})

    found = _met(blocks, anchors, shards).mapInPandas(run, "anchor long, anchor_id long, score long, positive_id long, positive long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def between(blocks: DataFrame, anchors: DataFrame, bounds: DataFrame, shards: int, width: int, n: int, steps: tuple[int, ...], slack: float) -> DataFrame:
    """anchor, place, negative_id, score, rank: for each of an anchor's bounds (place, low, high), the first ``n`` rows of other labels with a product in them."""
    # Bounds go with their anchor block: an anchor has a few.
    one = anchors.select("block", "uid").mapInPandas(_members, "block long, anchor long")
    lists = one.join(bounds, "anchor").groupBy("block").agg(F.collect_list(F.struct("anchor", "place", "low", "high")).alias("bounds"))
    bound_anchors = anchors.join(lists, "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, a, best = None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.a_block != held:
                    if best is not None:
                        yield emit(a, best, owner, place)
                    held, a = row.a_block, Block(row, "a_", width, len(steps))
                    wanted = sorted((x["anchor"], x["place"], x["low"], x["high"]) for x in row.a_bounds)
                    uids = np.array([w[0] for w in wanted], np.int64)
                    order = np.argsort(a.uid)
                    owner = order[np.searchsorted(a.uid[order], uids)]
                    place, low, high = (np.array([w[k] for w in wanted], np.int64) for k in (1, 2, 3))
                    best = Best(len(wanted), n)
                    most = np.full(len(a.uid), -np.inf)
                    np.maximum.at(most, owner, high.astype(np.float64))
                b = Block(row, "", width, len(steps))
                # An anchor's lists are judged together first: from the lowest bound that is open to the highest.
                need = np.maximum(low, best.worst())
                least = np.full(len(a.uid), np.inf)
                np.minimum.at(least, owner, need.astype(np.float64))
                i, j = survivors(a, b, a.label[:, None] != b.label[None, :], least, most, steps, slack)
                s = products(a, b, i, j)
                for k in range(int(np.bincount(owner, minlength=1).max(initial=0))):
                    mine = nth(owner, k, len(a.uid))  # the k-th list of each anchor, -1 for none
                    at = mine[i]
                    fit = (at >= 0) & (s >= need[at]) & (s <= high[at])
                    best.add(np.stack([at[fit], s[fit], b.vec_id[j[fit]], b.uid[j[fit]]], axis=1))
        if best is not None:
            yield emit(a, best, owner, place)

    def nth(owner: np.ndarray, k: int, n_anchors: int) -> np.ndarray:
        """The place of each anchor's k-th list; lists are ordered by owner's uid, so an owner's stand together."""
        out = np.full(n_anchors, -1)
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(owner))
        has = begins + k < ends
        out[owner[begins[has]]] = begins[has] + k
        return out

    def emit(a: Block, best: Best, owner: np.ndarray, place: np.ndarray) -> pd.DataFrame:
        r = best.rows
        return pd.DataFrame({"anchor": a.uid[owner[r[:, 0]]], "place": place[r[:, 0]], "score": r[:, 1], "negative_id": r[:, 2], "negative": r[:, 3]})

    found = _met(blocks, bound_anchors, shards).mapInPandas(run, "anchor long, place long, score long, negative_id long, negative long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative_id", "negative")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, uid in zip(batch["block"], batch["uid"]):
            yield pd.DataFrame({"block": block, "anchor": np.frombuffer(uid, np.int64)})


def _floor_100(n: Column) -> Column:
    """Hundredths of an integer, rounded down."""
    return F.call_function("div", n - F.pmod(n, F.lit(100)), F.lit(100))


def mine(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides; each has its first ``positives`` other rows of
    the same label, and for each of them the first ``negatives`` rows of other labels whose score is
    ``least`` to ``most`` hundredths of the positive's. Scores are integer inner products, higher
    ones first, ties by the smaller id.

    Defined cases: rows with a null id, label or vector, or with a component that is null, NaN,
    infinite or beyond ``LARGEST``, take no part; a vector shorter than others counts as followed by zeros, an
    empty one scores 0 with all; repeated rows, ids included, are rows of their own, so one may be
    the other's positive; an anchor without positives or without such negatives has no rows; an empty
    table gives none; further columns are never read.
    """
    sound = usable(vectors, id_col, vector, label)
    rows = settle(sound.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n_rows, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 1, 1)
    axes, slack = rotation(rows, width)
    steps = tuple(sorted({min(s, width) for s in STEPS}))
    blocks = settle(packed(rows, axes, ROWS, steps), "rows")
    chosen = rows.where(F.col("vec_id") % every == 0).repartition(max(8, n_rows // (every * ANCHORS)), "uid")
    anchors = settle(packed(chosen, axes, ANCHORS, steps), "anchors")
    # Anchors are copied to every shard: up to 64 shards hold one block each, more hold 32 and the copies stay few.
    n_blocks = n_rows // ROWS + 1
    shards = max(min(n_blocks, 64), n_blocks // 32)
    found = settle(nearest_of_label(blocks, anchors, shards, width, positives, steps, slack), "positives")
    # least * positive <= 100 * score <= most * positive, in integers.
    low, high = (_floor_100(F.col("score") * -least) * -1).alias("low"), _floor_100(F.col("score") * most).alias("high")
    bounds = found.select("anchor", F.col("place").cast("long").alias("place"), low, high)
    far = between(blocks, anchors, bounds.where("low <= high"), shards, width, negatives, steps, slack)
    return found.select("anchor", F.col("place").cast("long").alias("place"), "anchor_id", "positive_id", F.col("score").alias("positive_score")).join(
        far.select("anchor", "place", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("negative_score")), ["anchor", "place"]
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same by all pairs of anchors and rows.
ORACLE_SQL = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LARGEST})) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, ROW_NUMBER() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
