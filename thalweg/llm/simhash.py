"""SimHash near-deduplication with deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints at four or fewer differing bits
have a segment that differs in at most one bit, so they share a *variant*: that segment with one
of its bits masked out. Each distinct fingerprint is indexed under its 64 variants; fingerprints
meeting under an equal variant are compared in full, and the links give components by union.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, forget, settle

WORDS = 4
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of a variant that one task compares at once; longer runs are dealt as pairs of blocks.
BLOCK = 16384
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each word shingle; words are split at ASCII white space, A-Z lower-cased."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes; no word: zero."""
    h = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, max(1, len(h) // 65536)):
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > len(h)).astype(np.uint8))
    return int(packed.view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(x) for x in b["text"]), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """The 64 one-wildcard segment variants of each fingerprint: the other bits of the segment, and which bit is out."""
    made = []
    for start, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            tag = start + bit  # which bit of the 64 is masked out also names the segment
            made.append(F.shiftleft(segment.bitwiseAND(F.lit(~(1 << bit))), 6).bitwiseOR(F.lit(tag)))
    return fps.select("fp", F.explode(F.array(*made)).alias("variant"))


def _linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance  # of a signed number it counts the absolute value


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within ``distance`` in one run, as a spanning forest: no more links than rows.

    Rows are visited breadth first; each row is compared with all rows not yet reached at once.
    """
    out, rest = [], np.arange(len(fp))
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = _linked(fp[rest], fp[x], distance)
            for y in rest[near]:
                out.append((int(fp[x]), int(fp[y])))
                stack.append(y)
            rest = rest[~near]
    return out


def _compare(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by run; a run that crosses batches is carried over (it holds two blocks at most)."""
        held: list[pd.DataFrame] = []
        for b in batches:
            if len(b):
                last = b["variant"].iat[-1], b["deal"].iat[-1]
                tail = ((b["variant"] == last[0]) & (b["deal"] == last[1])).to_numpy()
                if tail.all() and held and (held[-1]["variant"].iat[-1], held[-1]["deal"].iat[-1]) == last:
                    held.append(b)
                    continue
                yield links(pd.concat([*held, b[~tail]]) if held else b[~tail])
                held = [b[tail]]
        if held:
            yield links(pd.concat(held))

    def links(b: pd.DataFrame) -> pd.DataFrame:
        fp = b["fp"].to_numpy(np.int64)
        v, d = b["variant"].to_numpy(np.int64), b["deal"].to_numpy(np.int64)
        cut = np.flatnonzero((v[1:] != v[:-1]) | (d[1:] != d[:-1])) + 1
        start = np.concatenate([[0], cut]) if len(fp) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([start, [len(fp)]]))
        pairs: list[tuple[int, int]] = []
        lefts, rights = [], []
        short = size <= 16
        run_of = np.repeat(np.arange(len(start)), size)
        for step in range(1, 16):  # short runs: all rows of the batch at a fixed distance at once
            i = np.flatnonzero((run_of[step:] == run_of[:-step]) & short[run_of[:-step]]) if len(fp) > step else np.zeros(0, np.int64)
            i = i[_linked(fp[i], fp[i + step], distance)]
            lefts.append(fp[i])
            rights.append(fp[i + step])
        for s, n in zip(start[~short], size[~short]):
            pairs += _forest(fp[s : s + n], distance)
        a = np.concatenate([*lefts, np.array([p[0] for p in pairs], np.int64)])
        c = np.concatenate([*rights, np.array([p[1] for p in pairs], np.int64)])
        return pd.DataFrame({"a": np.minimum(a, c), "b": np.maximum(a, c)}).drop_duplicates()

    return run


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (``a`` < ``b``, fingerprints) that connect all distinct ``fp`` at ``distance`` or fewer
    differing bits; within a variant a spanning forest stands for all its links.

    A variant with more than ``block`` fingerprints is cut into blocks, and each pair of blocks is
    one run: a task holds two blocks at most, and every pair of fingerprints still meets.
    """
    if not 0 <= distance <= 5:
        raise ValueError("three segments with one wildcard serve distances up to 5")
    rows = variants(fps)
    big = (
        rows.groupBy("variant").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .select("variant", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    )
    dealt = rows.join(big, "variant", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A row of block i goes to the runs (i, j) and (j, i) of every other block j: one run for each pair.
    deals = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.least("own", j).cast("long") * F.col("blocks") + F.greatest("own", j),
        )
    )
    runs = dealt.select("variant", "fp", F.explode(deals).alias("deal"))
    return (
        runs.repartition("variant", "deal")
        .sortWithinPartitions("variant", "deal", "fp")
        .mapInPandas(_compare(distance), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id.

    Defined cases: null, empty and white-space texts have fingerprint zero and are linked like any
    other; texts under four words are one shingle; equal fingerprints are one component whatever
    their number; repeated ids give repeated rows, and different texts under one id are judged apart;
    an empty table gives no rows; further columns
    are never read.
    """
    rows, named = _grouped(docs, id_col, text, distance)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text: str, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(doc_id and fp of each row; fp, root and component_id of each fingerprint)."""
    rows = settle(fingerprints(docs, id_col, text), "fingerprints")
    # Copies fold into one fingerprint, which stands for all of them; different texts under one id stay apart.
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = settle(links(nodes.select("fp"), distance), "links")
    roots = components(found)
    forget(found)
    named = settle(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, named.join(least, "root").select("fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each group of near duplicates; columns as they came.

    Null, empty and white-space texts are near duplicates of each other; of rows that repeat an id
    within a group, whole rows included, one stays; different texts under one id are judged apart;
    rows with a null id are kept only where their group has no other; an empty table gives no rows.
    """
    rows, named = _grouped(docs, id_col, text)
    judged = rows.join(named, "fp")
    mine = judged.where("doc_id = component_id").select(F.col("doc_id").alias("__keep"))
    counted = settle(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__often")), "often")
    own = docs[id_col].cast("long")
    if counted.isEmpty():
        return docs.join(mine, own == mine["__keep"], "left_semi")
    # Rows that share an id are told apart by a number of their own.
    number = f"__row_{uuid.uuid4().hex[:8]}"
    shared = settle(docs.join(counted, own.eqNullSafe(counted["__often"]), "left_semi").withColumn(number, F.monotonically_increasing_id()), "shared")
    prints = fingerprints(shared, number, text).withColumnRenamed("doc_id", number).join(named, "fp")
    ids = shared.select(number, F.col(id_col).cast("long").alias("__id"))
    first = prints.join(ids, number).where("__id <=> component_id").groupBy("root").agg(F.min(number).alias(number)).select(number)
    single = docs.join(counted, own.eqNullSafe(counted["__often"]), "left_anti")
    kept = single.join(mine, single[id_col].cast("long") == mine["__keep"], "left_semi")
    return kept.unionByName(shared.join(first, number, "left_semi").drop(number))
