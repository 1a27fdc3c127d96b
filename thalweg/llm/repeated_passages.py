"""Removal of passages that occur elsewhere: windows sampled by their smallest gram, and groups of equal hashes.

This is not a suffix array: nothing is sorted, ranked or merged, and no neighbours are compared.
Minimizer sampling with hash grouping replaces it, because removal asks only whether a window of
``LENGTH`` bytes occurs again, not for its rank. A suffix array would give right results too. Names
are hashes: of a triple 64 bits within a 64-bit gram hash, of a core 128 bits; a collision in both
would take unequal windows for equal.

Two equal ``LENGTH``-byte strings must be compared from a place sampled in both. A fixed difference
cover modulo v gives such a place for any two positions, at a density of about 1 / sqrt(v); here
the cover is chosen by content: every window of ``LENGTH`` bytes samples the place of its smallest
hashed ``GRAM``-gram (leftmost of equals). Equal windows sample the same place, so the property of
a difference cover holds where it is needed, at a density of 2 / (LENGTH - GRAM + 2).

1. A sampled place has a triple (bytes before the place, its gram, bytes after it): rows are grouped
   by the gram's hash, and by the whole triple's hash within it.
2. A gram whose triples differ is cut into blocks of ``BLOCK`` windows, each again a triple (left
   rest, core common to the block's windows, right rest) under an exact or 128-bit name.
3. The remaining single windows are grouped by (their rest, the core's name).
4. A window is repeated if its name is counted more than once.

What a level leaves undecided is all that the next one sees. Copies of a triple go on as one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .textbytes import CHUNK, chunks, encode

LENGTH = 200
GRAM = 64
BLOCK = 16
_PLACE_BITS = np.uint64(21)


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + LENGTH + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2 ** 64, and a number for each byte; made once in a worker."""
    if not _tables:
        _tables["up"] = _powers(_BASE)
        _tables["down"] = _powers(pow(_BASE, -1, 1 << 64))
        _tables["byte"] = np.random.default_rng(23).integers(1, 1 << 62, 256).astype(np.uint64)
    return _tables[name]


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place, from prefix sums modulo 2 ** 64."""
    n = len(b)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_table("byte")[b] * _table("up")[:n], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * _table("down")[: n - gram + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def samples(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, sampled place, its gram hash) of each run of windows that sample one place.

    ``starts`` are where the texts in ``b`` begin; no window crosses a text's end.
    """
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(b)
    low = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    have, want = 1, LENGTH - GRAM + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    place = (low & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    ends = np.append(starts[1:], len(b))
    inside = np.zeros(len(b) + 1, np.int64)  # +1 where a text's windows begin, -1 after its last
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(inside)[: len(place)] > 0
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    new[starts[long & (starts < len(place))]] = True
    at = np.flatnonzero(new & valid)
    # A run ends before the next run or the next window that is not valid.
    stop = np.flatnonzero(new | ~valid)
    last = np.append(stop, len(place))[np.searchsorted(stop, at, side="right")] - 1
    return at, last, place[at], h[place[at]]


def _unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def store(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """uid, doc_id and the compressed text, as a table bucketed by uid: later steps bring their findings to it."""
    spark = docs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(3)
        for b in batches:
            texts = (encode(t if isinstance(t, str) else None) for t in b["text"])
            yield pd.DataFrame({"uid": b["uid"], "doc_id": b["doc_id"], "z": [pack.compress(t) if t else b"" for t in texts]})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    name = f"passage_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInPandas(run, "uid long, doc_id long, z binary")
    packed.repartition(buckets, "uid").write.format("parquet").bucketBy(buckets, "uid").saveAsTable(name)
    return spark.table(name)


def sampled_triples(texts: DataFrame) -> DataFrame:
    """name (of the gram), whole (of the triple), uid and span: first window, windows less one, place less first window, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uids = batch["uid"].to_numpy()
            for b, starts, owners, places in chunks(map(_unpacked, batch["z"]), LENGTH - 1):
                first, last, place, h = samples(b, starts)
                raw = b.tobytes()
                digest = xxhash.xxh3_64_intdigest
                whole = np.fromiter(
                    (digest(raw[f : t + LENGTH], p - f) for f, t, p in zip(first.tolist(), last.tolist(), place.tolist())), np.uint64, len(first)
                )
                part = np.searchsorted(starts, first, side="right") - 1
                at = first - starts[part] + places[part]
                span = at << 16 | (last - first) << 8 | (place - first)
                yield pd.DataFrame({"name": h.view(np.int64), "whole": whole.view(np.int64), "uid": uids[owners[part]], "span": span})

    return texts.select("uid", "z").mapInPandas(run, "name long, whole long, uid long, span long")


def named(rows: DataFrame, *ref: str) -> tuple[DataFrame, DataFrame]:
    """Rows (name, whole and ``ref``) whose whole is repeated; rows to look into further.

    A name that stands once holds no repeat. Of a name with several wholes, one row of each goes on:
    what is repeated within copies is known already. Names are counted by partial aggregates, and
    met again in a join that Spark can split where a name is frequent.
    """
    many = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1")
    met = settle(rows.join(many.select("name", (F.col("low") != F.col("high")).alias("mixed")), "name"), "met")
    alike = met.where("not mixed").select("name", "whole", *ref)
    mixed = met.where("mixed")
    wholes = settle(mixed.groupBy("name", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*ref)).alias("one")), "wholes")
    again = mixed.join(wholes.where("n > 1").select("name", "whole"), ["name", "whole"], "left_semi").select("name", "whole", *ref)
    return alike.unionByName(again), wholes.select("name", "whole", "one.*")


def block_triples(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks of the windows in ``spans`` (uid, span): name (core), whole (core and rests), uid, base (the last window's start), rest.

    ``rest`` is the bytes before and after the core, and the first and last window in the block.
    """
    wanted = spans.groupBy("uid").agg(F.collect_list("span").alias("spans"))
    core = LENGTH - BLOCK + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, z, wide in zip(batch["uid"], batch["z"], batch["spans"]):
                b = _unpacked(z)
                for span in np.asarray(wide).tolist():
                    first, last, place = span >> 16, (span >> 16) + (span >> 8 & 255), (span >> 16) + (span & 255)
                    for m in range((place - last) // BLOCK, (place - first) // BLOCK + 1):
                        base = place - BLOCK * m
                        lo, hi = max(first, base - BLOCK + 1), min(last, base)
                        name = xxhash.xxh3_128_digest(b[base : base + core], m)
                        left, right = b[lo:base], b[base + core : hi + LENGTH]
                        out.append((name, name + bytes([base - hi, base - lo, len(left)]) + left + right, uid, base))
            yield pd.DataFrame(out, columns=["name", "whole", "uid", "base"])

    return texts.join(wanted, "uid").select("uid", "z", "spans").mapInPandas(run, "name binary, whole binary, uid long, base long")


def window_names(blocks: DataFrame) -> DataFrame:
    """name (rest and core) and start of each window of the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for whole, uid, base in zip(batch["whole"], batch["uid"], batch["base"]):
                core, near, far, n = whole[:16], whole[16], whole[17], whole[18]
                left, right = whole[19 : 19 + n], whole[19 + n :]
                for t in range(near, far + 1):  # the window starts t bytes before the core
                    out.append((core + bytes([t]) + left[n - t :] + right[: BLOCK - 1 - t], uid, base - t))
            yield pd.DataFrame(out, columns=["name", "uid", "start"])

    return blocks.select("whole", "uid", "base").mapInPandas(run, "name binary, uid long, start long")


def covered(texts: DataFrame) -> DataFrame:
    """uid, first, last: windows that occur elsewhere too, as runs of starts."""
    same, open_spans = named(sampled_triples(texts), "uid", "span")
    runs = same.select("uid", F.shiftright("span", 16).alias("first"), (F.shiftright("span", 16) + F.shiftright("span", 8).bitwiseAND(F.lit(255))).alias("last"))
    blocks = settle(block_triples(texts, open_spans), "blocks")
    same, open_blocks = named(blocks, "uid", "base")
    near, far = (F.conv(F.hex(F.substring("whole", k, 1)), 16, 10).cast("long") for k in (17, 18))
    runs = runs.unionByName(same.select("uid", (F.col("base") - far).alias("first"), (F.col("base") - near).alias("last")))
    windows = settle(window_names(open_blocks), "windows")
    again = windows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    single = windows.join(again.select("name"), "name", "left_semi").select("uid", F.col("start").alias("first"), F.col("start").alias("last"))
    return runs.unionByName(single)


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first byte, end byte).

    Defined cases: null counts as empty; a text under ``LENGTH`` bytes keeps all; repeats within a
    text count like those across texts, overlapping ones too; rows that repeat, ids included, are
    elsewhere to each other; a text of any length is judged whole; an empty table gives no rows;
    further columns are never read.
    """
    texts = store(docs, id_col, text)
    marks = covered(texts).groupBy("uid").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, z, first, last in zip(batch["doc_id"], batch["z"], batch["first"], batch["last"]):
                b = _unpacked(z)
                spans = merged(first, last) if first is not None else np.zeros((0, 2), np.int64)
                digest, at = hashlib.sha256(), 0
                for lo, hi in spans.tolist():
                    digest.update(b[at:lo])
                    at = hi
                digest.update(b[at:])
                out.append((doc_id, len(b), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest(), spans.tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.join(marks, "uid", "left").select("doc_id", "z", "first", "last").mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )


def merged(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maximal byte ranges covered by the windows in runs of starts."""
    first, end = np.asarray(first, np.int64), np.asarray(last, np.int64) + LENGTH
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(first[1:] > end[:-1])
    return np.stack([first[np.append(0, cut + 1)], end[np.append(cut, len(end) - 1)]], axis=1)
