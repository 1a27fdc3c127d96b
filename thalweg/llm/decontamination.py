"""Benchmark decontamination under edit distance, by unedited pieces of the items.

Texts and items are sequences of words (A-Z lower-cased, split at white space). An item that may
have k edits is cut into k + 1 pieces that cover it. Each edit touches one piece at most, so every
stretch of a text within k edits holds one piece unedited: texts are looked up for the pieces at
every word, and the exact edit distance between the item and any stretch of the text around a piece
decides. No similar stretch is missed, whatever its length, place and edits (up to collisions of
64-bit word hashes). This stands in for CGK embedding with bit sampling, whose keys of a few steps
miss edited items and whose number of repeats for a given recall grows too large at 20 % of edits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle
from .textbytes import encode

#: Diagonals that are compared at once.
STRIDE = 4
#: Words of a piece that make its key, at most.
KEY_WORDS = 8
SIMILARITY = 0.8
#: Items compared with the corpus at once; more items take further passes over it.
ITEM_BLOCK = 20_000
#: Words of texts that are held at once (a longer text alone).
SLICE = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.concatenate([[1], np.full(4095, int(_MULT))]).astype(np.uint64), dtype=np.uint64)
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(text: str | None) -> np.ndarray:
    """64-bit hash of each word."""
    b = np.frombuffer(encode(text).translate(_LOWER) + b" ", np.uint8)
    space = _SPACE[b]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64)
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    inside = ~space
    size = end - start
    # Place of each byte in its word; bytes of a word are summed under powers of that place.
    at = np.arange(len(b))[inside] - np.repeat(start, size)
    with np.errstate(over="ignore"):
        terms = _BYTE[b[inside]] * _POWERS[at % len(_POWERS)]
        sums = np.add.reduceat(terms, np.cumsum(size) - size)
        return _mix(sums + size.astype(np.uint64) * _MULT)


def keys(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on that has as many."""
    n = max(0, len(w) - size + 1)
    found = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            found = (found ^ w[k : n + k]) * _MULT + np.uint64(k)
    return _mix(found)


@dataclass
class Items:
    """Items in memory: a bounded block of the benchmark, with the keys of their pieces."""

    ids: list[int]
    words: list[np.ndarray]
    sizes: list[int]  # words of the keys
    keys: np.ndarray  # sorted
    owner: np.ndarray  # item of each key
    offset: np.ndarray  # the item's word at which the piece starts
    seen: np.ndarray  # a bit for each 20-bit prefix of a key


def allowed(length: int, similarity: float = SIMILARITY) -> int:
    """Edits that leave an item of ``length`` words similar."""
    return int(length * (1 - similarity) + 1e-9)


def pieces(length: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(start, words) of one piece more than the item may have edits; together they cover it."""
    n = min(allowed(length, similarity) + 1, length)
    cuts = [length * i // n for i in range(n + 1)] if n else []
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def index(items: list[tuple[int, str]], similarity: float = SIMILARITY) -> Items:
    made, owner, offset, texts, sizes = [], [], [], [], set()
    for n, (_, text) in enumerate(items):
        w = words(text)
        texts.append(w)
        for start, size in pieces(len(w), similarity):
            size = min(size, KEY_WORDS)
            sizes.add(size)
            made.append(keys(w[start : start + size], size)[0])
            owner.append(n)
            offset.append(start)
    k = np.array(made, np.uint64)
    order = np.argsort(k, kind="stable")
    seen = np.zeros(1 << 20, bool)
    seen[(k >> np.uint64(44)).astype(np.int64)] = True
    return Items([i for i, _ in items], texts, sorted(sizes), k[order], np.array(owner, np.int64)[order], np.array(offset, np.int64)[order], seen)


def best_stretch(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of ``text`` at the smallest word edit distance from ``item``; None beyond ``most``.

    Ties go to the earliest end. Free ends in the text: the usual dynamic programme by rows, the
    moves along a row taken as a running minimum.
    """
    n = len(text)
    steps = np.arange(n + 1)
    cost = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    for i, w in enumerate(item):
        diagonal = np.concatenate([[i + 1], cost[:-1] + (text != w)])
        down = cost + 1
        best = np.minimum(diagonal, down)
        origin = np.where(diagonal <= down, np.concatenate([[0], start[:-1]]), start)
        # Moving right costs one a step: the least of (best - place) so far, plus place.
        level = best - steps
        run = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == run, steps, 0))
        cost, start = run + steps, origin[source]
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


def scan(texts: list[np.ndarray], items: Items, similarity: float = SIMILARITY) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text (item index, first word, end word, edits, item words) of the items found in it: the best stretch of each."""
    gap = np.zeros(1, np.uint64)
    out: list[list[tuple[int, int, int, int, int]]] = []
    group: list[np.ndarray] = []
    size = 0
    for w in texts:
        group += [w, gap]
        size += len(w)
        if size >= SLICE:
            out += _scan(group, items, similarity)
            group, size = [], 0
    return out + (_scan(group, items, similarity) if group else [])


def _scan(group: list[np.ndarray], items: Items, similarity: float) -> list[list[tuple[int, int, int, int, int]]]:
    """Texts, each followed by a gap that no piece holds, are looked up together."""
    texts, gap = group[::2], len(group[1])
    low = np.cumsum([0] + [len(w) + gap for w in texts])
    every = np.concatenate(group)
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    tried: set[tuple[int, int, int]] = set()
    for size in items.sizes:
        all_keys = keys(every, size)
        at = np.flatnonzero(items.seen[(all_keys >> np.uint64(44)).astype(np.int64)])
        k = all_keys[at]
        left, right = np.searchsorted(items.keys, k, "left"), np.searchsorted(items.keys, k, "right")
        hit = np.flatnonzero(left < right)
        which = np.searchsorted(low, at[hit], side="right") - 1
        for a, b, t, place in zip(left[hit].tolist(), right[hit].tolist(), which.tolist(), (at[hit] - low[which]).tolist()):
            for j in range(a, b):
                n = int(items.owner[j])
                guess = place - int(items.offset[j])
                if (t, n, guess // STRIDE) in tried:
                    continue
                tried.add((t, n, guess // STRIDE))
                item, w = items.words[n], texts[t]
                most = allowed(len(item), similarity)
                first = max(0, guess - most - STRIDE)
                # Nothing further on is better than an unedited copy.
                if n in found[t] and found[t][n][0] == 0 and found[t][n][1] <= first:
                    continue
                region = w[first : guess + len(item) + most + STRIDE]
                # Every item word that the region lacks costs an edit.
                if np.isin(item, region).sum() < len(item) - most:
                    continue
                stretch = best_stretch(item, region, most)
                if stretch and (n not in found[t] or (stretch[0], first + stretch[1]) < found[t][n][:2]):
                    found[t][n] = (stretch[0], first + stretch[1], first + stretch[2])
    return [[(n, s, e, d, len(items.words[n])) for n, (d, s, e) in sorted(f.items())] for f in found]


HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
            T.StructField("edits", T.IntegerType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
)


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size, in item order; null texts are no items."""
    block: list[tuple[int, str]] = []
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _hits(docs: DataFrame, benchmark: DataFrame, similarity: float, name: str) -> DataFrame:
    """``docs`` with a column ``name`` of hits. One block of items is in memory at a time: a benchmark
    of more takes a pass over the documents for each block, whose hits are written before the next."""
    context = docs.sparkSession.sparkContext

    def finder(shared):
        @F.pandas_udf(HITS)
        def hits(text: pd.Series) -> pd.Series:
            items = shared.value
            found = scan([words(t if isinstance(t, str) else None) for t in text], items, similarity)
            return pd.Series([[(items.ids[n], s, e, d, 1 - d / m) for n, s, e, d, m in hits] for hits in found])

        return hits(F.col("text"))

    blocks = _blocks(benchmark, ITEM_BLOCK)
    block, more = next(blocks, None), next(blocks, None)
    if block is None:
        return docs.withColumn(name, F.lit(None).cast(HITS))
    if more is None:
        return docs.withColumn(name, finder(context.broadcast(index(block, similarity))))
    row = f"{name}_row"
    base = settle(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    passes = []
    for part in chain([block, more], blocks):
        shared = context.broadcast(index(part, similarity))
        passes.append(settle(base.select(row, finder(shared).alias(name)).where(F.size(name) > 0), "hits"))
        shared.destroy()
    merged = reduce(DataFrame.unionByName, passes).groupBy(row).agg(F.flatten(F.collect_list(name)).alias(name))
    return base.join(merged, row, "left").drop(row)


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, contaminated, n_items and hits (item_id, first_word, end_word, edits, similarity) of every document.

    A document is contaminated if a stretch of it is within (1 - similarity) x item words edits of
    an item. Defined cases: null and empty texts, and empty items, have no hits; an item shorter
    than five words must be there unedited; no stretch within the edits is missed; copies of an item in one text count once, at the best
    stretch; equal item ids with different texts are different items; no item: no hits; an empty
    table gives no rows; further columns are never read.
    """
    rows = _hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, similarity, "hits")
    size = F.coalesce(F.size("hits"), F.lit(0))
    return rows.select("doc_id", (size > 0).alias("contaminated"), F.greatest(size, F.lit(0)).cast("long").alias("n_items"), "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no item is found; columns as they came.

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty benchmark
    keeps all; an empty table gives no rows.
    """
    mine = f"__hits_{uuid.uuid4().hex[:8]}"
    return _hits(docs, benchmark, similarity, mine).where(F.coalesce(F.size(mine), F.lit(0)) <= 0).select(*docs.columns)
