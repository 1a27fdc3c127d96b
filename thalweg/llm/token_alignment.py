"""Alignment of two tokenizers over the same texts, by bitsets of token ends.

A token's end is a bit at its byte offset. The AND of the two bitsets holds the shared cuts, the OR
one bit for each pair of overlapping tokens: the stretch of text up to a bit lies in one token of
each side. Popcounts rank a bit among a side's ends, which is the number of the token there.

A text is cut into units before spaces that stand alone between other characters, as far as neither
tokenizer can have a token across such a place (``separable`` tells from the tokenizer files). Both
tokenizers end a token there, so a unit is encoded and aligned once in a task however often it
occurs. Where the files do not promise it, a text is one unit.

An id pair's count is the number of documents that hold it linked. Documents are aligned in blocks
of bounded size; a block names each of its pairs once, with the number of its documents, so pairs
are summed and their counts brought back by block, not by link.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settle

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Units that a task remembers, and their mean length; units that are encoded at once.
MEMO_UNITS, MEMO_CHARS, ENCODED = 300_000, 64, 10_000
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros((size + 64) // 64 * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """The number of bits below each place."""
        word, low = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Pair:
    """The two tokenizers of a task: encoders, the bytes of their ids, and whether texts may be cut at lone spaces."""

    byte_level: str
    pieces: str

    def __post_init__(self):
        # Spark's tasks are the parallelism; set before the library is loaded.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        with open(self.byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        self._a = Tokenizer.from_file(self.byte_level)
        self._a.encode_special_tokens = True  # their strings in a text are ordinary text
        self._b = sentencepiece.SentencePieceProcessor(model_file=self.pieces)
        alphabet = byte_level_alphabet()
        vocabulary = self._a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.separable = separable(spec, pieces)
        self.length_a, self.length_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        # What an id looks like in the groups' text: within its side, and at its side's end.
        self.shown_a, self.shown_b = (np.array([[f"{i}{m}" for m in (",", end)] for i in range(len(t))], object) for t, end in ((self.bytes_a, "|"), (self.bytes_b, ";")))

    def ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        left: list[list[int]] = []
        for at in range(0, len(units), ENCODED):  # an encoding holds far more than ids
            left += [e.ids for e in self._a.encode_batch_fast([" " + u for u in units[at : at + ENCODED]], add_special_tokens=False)]
        return left, self._b.encode(units, num_threads=1)


def separable(spec: dict, pieces: list[str]) -> bool:
    """Whether no token of either side runs across a lone space: byte-level words start with their
    space, and no piece has the space sign after another character."""
    before = spec.get("pre_tokenizer") or {}
    words = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
    return bool(words) and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)


@lru_cache(maxsize=1)
def _pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


class _Numbers(dict):
    """Numbers in the order of first use."""

    def __missing__(self, unit: str) -> int:
        found = self[unit] = len(self)
        return found


class Units:
    """Distinct units of a task: counts of tokens, groups and links, the groups' text, and the linked id pairs."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.size, self.valid = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.text: list[str] = []
        self.links, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, units: list[str]) -> list[int]:
        """Numbers of the units; new ones wait for ``learn``."""
        return list(map(self.number.__getitem__, units))

    def learn(self) -> None:
        """Encode and align the units that are new."""
        new = list(self.number)[len(self.valid) :]
        if not new:
            return
        sizes, valid, texts, links, counts = aligned(self.pair, new)
        self.size = np.concatenate([self.size, sizes])
        self.valid = np.concatenate([self.valid, valid])
        self.text += texts
        self.links = np.concatenate([self.links, links])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])


def aligned(pair: Pair, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links of each unit; whether both sides spell it; groups' texts; linked pairs, unit after unit; how many each)."""
    all_a, all_b = pair.ids(units)
    spelled = [(" " + u).encode() for u in units]
    good = _spelled(pair, spelled, all_a, all_b)
    valid = np.zeros(len(units), bool)
    valid[good] = True
    size = np.zeros((len(units), 4), np.int64)
    texts, counts = [""] * len(units), np.zeros(len(units), np.int64)
    if not len(good):
        return size, valid, texts, np.zeros(0, np.int64), counts
    if len(good) < len(units):
        spelled, all_a, all_b = ([x[i] for i in good] for x in (spelled, all_a, all_b))
    stop = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (all_a, all_b))
    a, b = _flat(all_a), _flat(all_b)
    # The bit of a token is its last byte.
    in_a, in_b = Bits.at(np.cumsum(pair.length_a[a]) - 1, int(stop[-1])), Bits.at(np.cumsum(pair.length_b[b]) - 1, int(stop[-1]))
    shared, either = in_a & in_b, in_a | in_b
    segment = either.select()
    links = a[in_a.rank(segment)] << 32 | b[in_b.rank(segment)]
    n_links = np.diff(either.rank(stop), prepend=0)
    n_groups = np.diff(shared.rank(stop), prepend=0)
    size[good] = np.stack([n_a, n_b, n_groups, n_links], axis=1)
    counts[good] = n_links
    # Tokens of both sides in the order of the groups' text: a group's A ids, then its B ids.
    cut = shared.select()
    upto_a, upto_b = in_a.rank(cut + 1), in_b.rank(cut + 1)
    group_a, group_b = np.repeat(np.arange(len(cut)), np.diff(upto_a, prepend=0)), np.repeat(np.arange(len(cut)), np.diff(upto_b, prepend=0))
    place_a = np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    end_a[upto_a - 1] = end_b[upto_b - 1] = 1
    shown = np.empty(len(a) + len(b), object)
    shown[place_a], shown[place_b] = pair.shown_a[a, end_a], pair.shown_b[b, end_b]
    shown, at = shown.tolist(), 0
    for i, n in zip(good.tolist(), (n_a + n_b).tolist()):
        texts[i] = "".join(shown[at : at + n])[:-1]
        at += n
    return size, valid, texts, links, counts


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64)


def _spelled(pair: Pair, spelled: list[bytes], all_a: list[list[int]], all_b: list[list[int]]) -> np.ndarray:
    """Places of the units whose tokens spell them byte for byte on both sides."""
    join = lambda ids, table: b"".join(map(table.__getitem__, ids))
    same = np.ones(len(spelled), bool)
    for ids, table, length in ((all_a, pair.bytes_a, pair.length_a), (all_b, pair.bytes_b, pair.length_b)):
        flat = _flat(ids)
        ends = np.concatenate([[0], np.cumsum(length[flat])])[np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
        if (ends == np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))).all() and join(flat.tolist(), table) == b"".join(spelled):
            continue
        same &= np.fromiter((join(i, table) == want for i, want in zip(ids, spelled)), bool, len(spelled))
    return np.flatnonzero(same)


_BLOCKS = "block long, head boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, data binary"


def blocks(docs: DataFrame, byte_level: str, pieces: str, id_col: str, text: str, with_groups: bool) -> DataFrame:
    """A row for each document, and for each block a head row.

    A document's data: its distinct units (places in the block's list) and how often each occurs.
    A head's: the pairs of the block's units (places in its list of pairs), the pairs and how many
    of the block's documents hold each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units(_pair(byte_level, pieces))
        made, ids, texts, held = 0, [], [], 0
        number = lambda: TaskContext.get().partitionId() << 33 | made
        for batch in batches:
            for doc_id, t in zip(batch["doc_id"], batch["text"]):
                t = t if isinstance(t, str) else ""
                if held + len(t) > BLOCK_CHARS and held:
                    yield _block(number(), ids, texts, units, with_groups)
                    made, ids, texts, held = made + 1, [], [], 0
                ids.append(doc_id)
                texts.append(t)
                held += len(t)
        if ids:
            yield _block(number(), ids, texts, units, with_groups)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, _BLOCKS)


def _block(block: int, ids: list, texts: list[str], units: Units, with_groups: bool) -> pd.DataFrame:
    if len(units.number) > MEMO_UNITS or sum(map(len, units.number)) > MEMO_UNITS * MEMO_CHARS:
        units.clear()
    cut = units.pair.separable
    owned = [units.numbers(_LONE_SPACE.split(t) if cut else [t]) if t else [] for t in texts]
    units.learn()
    whole = [i for i, o in enumerate(owned) if o and not units.valid[o].all()]
    for i in whole:  # a unit that is not spelled by both sides: judge the text as one
        owned[i] = units.numbers([texts[i]])
    units.learn()
    own = [o if o and units.valid[o].all() else [] for o in owned]
    # Distinct (document, unit), how often each occurs, and where a document's begin.
    each = np.repeat(np.arange(len(own)), list(map(len, own)))
    wide = max(len(units.number), 1)
    key, times = np.unique(each * wide + _flat(own), return_counts=True)
    doc, unit = key // wide, key % wide
    begin = np.searchsorted(doc, np.arange(len(own) + 1))
    # The block's own list of units and of pairs, and its units' places in the latter.
    used, place = np.unique(unit, return_inverse=True)
    links, spread = _spread(units.links, units.first, used)
    pairs, at = np.unique(links, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(spread)])
    # Documents that hold a pair: distinct (document, pair), a bounded number of documents at a time.
    docs_with, step, many = np.zeros(len(pairs), np.int64), 256, max(len(pairs), 1)
    for lo in range(0, len(own), step):
        part = slice(begin[lo], begin[min(lo + step, len(own))])
        expanded, n = _spread(at, starts, place[part])
        held = np.sort((np.repeat(doc[part], n) - lo) * many + expanded)
        docs_with += np.bincount(held[np.append(True, held[1:] != held[:-1])] % many, minlength=len(pairs)) if len(held) else 0
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(units.size[unit] * times[:, None], axis=0)])
    sizes = (sums[begin[1:]] - sums[begin[:-1]]).tolist()
    rows = []
    for i, (doc_id, o) in enumerate(zip(ids, own)):
        groups = ";".join(map(units.text.__getitem__, o))
        digest = hashlib.sha256(groups.encode()).hexdigest() if o else ""
        part = slice(begin[i], begin[i + 1])
        rows.append((block, False, doc_id, *sizes[i], groups if with_groups else None, digest, _packed(np.diff(place[part], prepend=0), times[part])))
    head = _packed(np.diff(starts), at, pairs & 0xFFFFFFFF, pairs >> 32, docs_with)
    rows.append((block, True, None, 0, 0, 0, 0, None, None, head))
    if whole:
        units.clear()  # whole texts are not worth remembering
    found = pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCKS.split(", ")])
    found["doc_id"] = found["doc_id"].astype("Int64")
    return found


def _spread(values: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of the chosen lists one after the other, how many each has); list i is values[first[i]:first[i + 1]]."""
    many = first[chosen + 1] - first[chosen]
    begin = np.cumsum(many) - many
    return values[np.arange(int(many.sum())) + np.repeat(first[chosen] - begin, many)], many


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2 ** 32, compressed byte plane by byte plane."""
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays]
    sizes = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    return zstandard.ZstdCompressor(1).compress(sizes + b"".join(planes))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    out, at = [], 4 * (count + 1)
    for n in np.frombuffer(raw, "<u4", count, 4).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
        at += 4 * n
    return out


def _head(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, places, pairs, documents) of a block's head."""
    spread, at, low, high, n_docs = _unpacked(data)
    return np.concatenate([[0], np.cumsum(spread)]), at, high << 32 | low, n_docs


def pair_counts(heads: DataFrame) -> DataFrame:
    """block, pair, n_docs: the id pairs of each block and how many of its documents hold them linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data in zip(batch["block"], batch["data"]):
                _, _, pairs, n = _head(data)
                yield pd.DataFrame({"block": block, "pair": pairs, "n_docs": n})

    return heads.select("block", "data").mapInPandas(run, "block long, pair long, n_docs long")


def scored_pairs(by_block: DataFrame) -> DataFrame:
    """pair, a, b, n_docs, best: counts over the corpus, and whether no other pair of the A id has more. An A id has as many rows as there are B ids, at most."""
    total = by_block.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    a = F.shiftrightunsigned("pair", 32)
    ranked = total.withColumn("a", a).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return ranked.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups).

    ``byte_level`` is a byte-level tokenizer file, ``pieces`` a piece model; both must be at the same
    place on every executor. Defined cases: null and empty texts, and texts that either side does
    not spell byte for byte, have no tokens, zeros and empty groups; repeated rows, ids included,
    are documents of their own; texts of any length are encoded whole; an empty table gives no rows;
    further columns are never read.
    """
    made = settle(blocks(docs, byte_level, pieces, id_col, text, with_groups), "aligned")
    by_block = settle(pair_counts(made.where("head")), "pairs")
    totals = scored_pairs(by_block).select("pair", "n_docs", "best")
    # A frequent pair stands once in every block, and once in the totals: a join that splits when skewed.
    known = settle(by_block.select("block", "pair").join(totals, "pair"), "counted")
    forget(by_block)

    def score(rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        starts, at, pairs, _ = _head(rows.loc[rows["head"], "data"].iat[0])
        order = np.argsort(counted["pair"].to_numpy())  # ``pairs`` is sorted too
        n, best = counted["n_docs"].to_numpy()[order], counted["best"].to_numpy(bool)[order]
        sums, bests = (np.concatenate([[0], np.cumsum(v[at] if len(at) else np.zeros(0, np.int64))]) for v in (n, best.astype(np.int64)))
        unit_sum, unit_best = np.diff(sums[starts]), np.diff(bests[starts])
        out = rows[~rows["head"]].copy()
        own = [(np.cumsum(steps), times) for steps, times in map(_unpacked, out["data"])]
        out["count_sum"] = [int((unit_sum[u] * k).sum()) for u, k in own]
        out["n_best"] = [int((unit_best[u] * k).sum()) for u, k in own]
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out[names]

    columns = ["doc_id long", "n_a long", "n_b long", "n_groups long", "n_links long", "n_best long", "count_sum long", "groups_sha256 string"]
    columns += ["groups string"] if with_groups else []
    names = [c.split()[0] for c in columns]
    return made.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(score, ", ".join(columns))
