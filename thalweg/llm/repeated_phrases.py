"""Removal of recurring word passages: recurring windows are found, compiled to automata by shard, and located in every document.

A window is ``LENGTH`` consecutive words of one document.

1. Candidates. Each window samples the place of its smallest hashed ``GRAM`` words (leftmost of
   equals), so equal windows sample the same place. Windows in a row with one place are a run, named
   by the gram there and by its whole stretch. Copies of a stretch are counted first; where a gram
   stands in several stretches, each distinct one is cut into windows and these are counted.
2. Passages. Of each window that is counted twice or more, the first place is its representative.
   Representatives in a row are a passage: every distinct recurring window is in one passage.
3. Automata. A passage is cut into seeds of ``SEED`` words without gaps; any window in it holds a
   whole seed. Words become single characters, so a step of an automaton is a word. Passages are dealt
   to shards of bounded size, and a shard's seeds are compiled into one Aho-Corasick automaton.
4. Occurrences. Each piece of a document goes to the shards that hold representatives of its
   candidates, and is streamed through their automata. A seed found is extended to both sides as far as
   words agree with the passage. A stretch of a window or more, compared byte by byte, marks the
   piece, and the passage where it comes from: hashes only propose, equal words decide.

A shard that many pieces need is dealt to as many tasks as they take; each compiles it anew.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .textbytes import encode

LENGTH = 35
GRAM = 8
#: Any window of a passage holds one of the passage's seeds: LENGTH >= 2 * SEED - 1.
SEED = 18
#: Windows in a piece of a document.
PIECE = 4096
#: Words of passages in a shard, at about 100 bytes of automaton each, and pieces that one task streams through it.
SHARD_WORDS, SHARD_PIECES = 500_000, 10_000
#: Places of one seed that are tried one by one; of a seed with more, the windows around it are looked up.
TRIED = 8
_MEMO = 1_000_000
_PLACE_BITS = np.uint64(22)
_BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """Hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class _Letters(dict):
    """A character for each word met; different words may share one."""

    def __missing__(self, word: bytes) -> str:
        if len(self) >= _MEMO:
            self.clear()
        found = self[word] = chr(0x10000 + (xxhash.xxh3_64_intdigest(word) & 0xFFFFF))
        return found


def words_of(text: str | None) -> list[bytes]:
    return encode(text).split()  # on the bytes 9 to 13 and 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Stretches:
    """Hashes of any stretch of a row of words, from prefix sums modulo 2 ** 64."""

    up, down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # powers, as far as a worker needed them

    def __init__(self, h: np.ndarray):
        if len(self.down) <= len(h):
            size = len(h) + len(h) // 4 + 1
            Stretches.up, Stretches.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def runs(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, sampled place, its gram's hash, the stretch's hash) of the runs of windows in word hashes.

    ``starts`` are where texts begin; no window crosses a text's end.
    """
    if len(h) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    s = Stretches(h)
    n = np.arange(len(h) - GRAM + 1)
    gram = s.of(n, n + GRAM)
    low = (gram >> _PLACE_BITS << _PLACE_BITS) | n.astype(np.uint64)
    have, want = 1, LENGTH - GRAM + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    place = (low & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    ends = np.append(starts[1:], len(h))
    long = ends - starts >= LENGTH
    inside = np.zeros(len(h) + 1, np.int64)  # +1 where a text's windows begin, -1 after its last
    inside[starts[long]] += 1
    inside[ends[long] - LENGTH + 1] -= 1
    valid = np.cumsum(inside)[: len(place)] > 0
    new = np.append(True, place[1:] != place[:-1])
    new[starts[long]] = True
    first = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), len(place))
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    place = place[first]
    return first, last, place, gram[place], _mixed(s.of(first, last + LENGTH) + (place - first).astype(np.uint64))


def groups(texts: Iterator[list[bytes]], size: int, overlap: int | None) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of some ``size`` words: (words, starts of parts, their texts, their places in these).

    Longer texts are cut to slices that overlap by ``overlap`` words, or stay whole where it is None.
    """
    words: list[bytes] = []
    starts, owners, places = [], [], []
    for i, text in enumerate(texts):
        step = size if overlap is not None else max(len(text), 1)
        for at in range(0, max(len(text) - (overlap or 0), 1), step):
            part = text[at : at + step + (overlap or 0)]
            if words and len(words) + len(part) > size:
                yield words, np.array(starts, np.int64), np.array(owners, np.int64), np.array(places, np.int64)
                words, starts, owners, places = [], [], [], []
            if part:
                starts.append(len(words))
                owners.append(i)
                places.append(at)
                words += part
    if words:
        yield words, np.array(starts, np.int64), np.array(owners, np.int64), np.array(places, np.int64)


#: Words that are hashed at once.
GROUP = 400_000


def _unpacked(z: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(z).split(b" ") if z else []


def store(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """uid, doc_id and the words with one space between them, compressed, as a table bucketed by uid: later steps bring their findings to it."""
    spark = docs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(3)
        for b in batches:
            joined = (b" ".join(words_of(t if isinstance(t, str) else None)) for t in b["text"])
            yield pd.DataFrame({"uid": b["uid"], "doc_id": b["doc_id"], "z": [pack.compress(j) if j else b"" for j in joined]}).astype({"doc_id": "Int64"})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    name = f"phrase_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInPandas(run, "uid long, doc_id long, z binary")
    packed.repartition(buckets, "uid").write.format("parquet").bucketBy(buckets, "uid").saveAsTable(name)
    return spark.table(name)


def sampled_runs(texts: DataFrame) -> DataFrame:
    """name (of the gram), whole (of the stretch), uid and span: first window, windows less one, place less first window, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            uids = batch["uid"].to_numpy(np.int64)
            for words, starts, owners, places in groups(map(_unpacked, batch["z"]), GROUP, LENGTH - 1):
                first, last, place, gram, whole = runs(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), starts)
                part = np.searchsorted(starts, first, side="right") - 1
                span = (first - starts[part] + places[part]) << 16 | (last - first) << 8 | (place - first)
                yield pd.DataFrame({"name": gram.view(np.int64), "whole": whole.view(np.int64), "uid": uids[owners[part]], "span": span})

    return texts.select("uid", "z").mapInPandas(run, "name long, whole long, uid long, span long")


def first_window(span) -> F.Column:
    return F.shiftright(span, 16)


def last_window(span) -> F.Column:
    return F.shiftright(span, 16) + F.shiftright(span, 8).bitwiseAND(F.lit(255))


def windows_of(texts: DataFrame, stretches: DataFrame) -> DataFrame:
    """name, whole, n, win (the window's hash), uid, start of the windows in stretches (name, whole, n, uid, span)."""
    columns = ("name", "whole", "n", "span")
    wanted = stretches.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    lists = [F.col("wanted")[c].alias(c) for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            uids = batch["uid"].to_numpy(np.int64)
            for words, starts, owners, _ in groups(map(_unpacked, batch["z"]), GROUP, None):
                s = Stretches(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                name, whole, n, span = (np.concatenate(batch[c].to_numpy()[owners]) for c in columns)
                text = np.repeat(np.arange(len(owners)), [len(x) for x in batch["span"].to_numpy()[owners]])
                many = (span >> 8 & 255) + 1
                start = np.repeat(span >> 16, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                of = lambda x: np.repeat(x, many)
                at = start + of(starts[text])
                yield pd.DataFrame({"name": of(name), "whole": of(whole), "n": of(n), "win": s.of(at, at + LENGTH).view(np.int64), "uid": of(uids[owners[text]]), "start": start})

    return texts.join(wanted, "uid").select("uid", "z", *lists).mapInPandas(run, "name long, whole long, n long, win long, uid long, start long")


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all runs; name, whole, rep, first, last: where the representatives of a stretch's recurring windows are).

    Stretches are counted before grams are, so that copies weigh no more than one row from there on.
    """
    every = settle(sampled_runs(texts), "runs")
    wholes = settle(every.groupBy("name", "whole").agg(F.count("*").alias("n"), F.min(F.struct("uid", "span")).alias("one")).select("name", "whole", "n", "one.*"), "stretches")
    many = wholes.groupBy("name").agg(F.sum("n").alias("total"), (F.count("*") > 1).alias("mixed")).where("total > 1").drop("total")
    met = settle(wholes.join(many, "name"), "met")
    span = F.col("span")
    alike = met.where("not mixed").select("name", "whole", F.col("uid").alias("rep"), first_window(span).alias("first"), last_window(span).alias("last"))
    windows = settle(windows_of(texts, met.where("mixed").drop("mixed")), "windows")
    again = windows.groupBy("name", "win").agg(F.sum("n").alias("total"), F.min(F.struct("uid", "start")).alias("r")).where("total > 1")
    single = windows.select("name", "whole", "win").join(again.select("name", "win", "r"), ["name", "win"])
    return every, settle(alike.unionByName(single.select("name", "whole", F.col("r.uid").alias("rep"), F.col("r.start").alias("first"), F.col("r.start").alias("last"))), "recurring")


def _pieces(first, last) -> F.Column:
    """The pieces that hold a run of windows."""
    return F.explode(F.sequence(F.floor(first / PIECE), F.floor(last / PIECE)))


def passages(texts: DataFrame, recurring: DataFrame) -> DataFrame:
    """uid, piece, base, words: maximal rows of representative windows in each piece, base the first word's place."""
    wanted = recurring.groupBy(F.col("rep").alias("uid")).agg(F.collect_set(F.struct("first", "last")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, z, wanted in zip(batch["uid"], batch["z"], batch["wanted"]):
                words = _unpacked(z)
                there = np.zeros(len(words) + 1, np.int64)
                np.add.at(there, [w["first"] for w in wanted], 1)
                np.add.at(there, [w["last"] + 1 for w in wanted], -1)
                for first, end in flagged(np.cumsum(there) > 0):
                    for k in range(first // PIECE, (end - 1) // PIECE + 1):
                        lo, hi = max(first, k * PIECE), min(end, (k + 1) * PIECE)
                        out.append((uid, k, lo, b" ".join(words[lo : hi + LENGTH - 1])))
            yield pd.DataFrame(out, columns=["uid", "piece", "base", "words"])

    return texts.join(wanted, "uid").select("uid", "z", "wanted").mapInPandas(run, "uid long, piece long, base long, words binary")


def flagged(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of true flags."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


def pieces(texts: DataFrame, routed: DataFrame) -> DataFrame:
    """shard, part, uid, base, words of the pieces of documents as routed (uid, piece, shard, part)."""
    wanted = routed.groupBy("uid").agg(F.collect_list(F.struct("piece", "shard", "part")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for uid, z, wanted in zip(batch["uid"], batch["z"], batch["wanted"]):
                words = _unpacked(z)
                cut = {k: b" ".join(words[k * PIECE : (k + 1) * PIECE + LENGTH - 1]) for k in {w["piece"] for w in wanted}}
                out += [(w["shard"], w["part"], uid, w["piece"] * PIECE, cut[w["piece"]]) for w in wanted]
                size += len(words) * max(1, len(wanted) // len(cut))
                if size > GROUP:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    names = ["shard", "part", "uid", "base", "words"]
    return texts.join(wanted, "uid").select("uid", "z", "wanted").mapInPandas(run, "shard long, part long, uid long, base long, words binary")


class Automaton:
    """The compiled passages of a shard: finds stretches of documents that agree with a passage for a window or more."""

    def __init__(self, rows: list[tuple[int, int, bytes]], letters: _Letters):
        self.letters = letters
        self.at = [(uid, base) for uid, base, _ in rows]
        self.words = [w.split(b" ") for _, _, w in rows]
        self.text = ["".join(map(letters.__getitem__, w)) for w in self.words]
        self.covered = [np.zeros(len(w), bool) for w in self.words]
        places: dict[str, list[tuple[int, int]]] = {}
        for p, text in enumerate(self.text):
            for o in range(0, len(text) - SEED + 1, SEED):
                places.setdefault(text[o : o + SEED], []).append((p, o))
        #: Windows around seeds that stand in many passages.
        self.windows: dict[str, list[tuple[int, int]]] = {}
        self.seeds = ahocorasick.Automaton()
        for seed, found in places.items():
            if len(found) <= TRIED:
                self.seeds.add_word(seed, found)
                continue
            self.seeds.add_word(seed, None)
            for p, o in found:
                text = self.text[p]
                for start in range(max(0, o + SEED - LENGTH), min(o, len(text) - LENGTH) + 1):
                    same = self.windows.setdefault(text[start : start + LENGTH], [])
                    if (p, start) not in same:
                        same.append((p, start))
        if places:
            self.seeds.make_automaton()

    def stretches(self, uid: int, base: int, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) in ``words`` of stretches found, which their passages remember too. A passage is not found at its own place."""
        text, out = "".join(map(self.letters.__getitem__, words)), []
        seen: dict[tuple[int, int], int] = {}
        if not len(self.seeds):
            return out
        for stop, found in self.seeds.iter(text):
            i = stop - SEED + 1
            if found is None:
                near = ((start, self.windows.get(text[start : start + LENGTH], ())) for start in range(max(0, i + SEED - LENGTH), i + 1))
                tried = [(p, i + o - start) for start, same in near for p, o in same]
            else:
                tried = found
            for p, o in tried:
                shift = i - o
                if seen.get((p, shift), -1) >= i + SEED or self.at[p] == (uid, base + shift):
                    continue
                lo, hi = self._extent(text, i, self.text[p], o)
                seen[p, shift] = hi
                for x, y in self._equal(words, lo, hi, self.words[p], lo - shift):
                    if y - x >= LENGTH:
                        out.append((x, y))
                        self.covered[p][x - shift : y - shift] = True
        return out

    @staticmethod
    def _extent(text: str, i: int, other: str, o: int) -> tuple[int, int]:
        """The widest stretch of ``text`` around i that agrees with ``other`` around o."""
        left, right = min(i, o), min(len(text) - i, len(other) - o)
        if text[i - left : i + right] == other[o - left : o + right]:
            return i - left, i + right
        a, b = 0, left
        while a < b:
            m = (a + b + 1) // 2
            a, b = (m, b) if text[i - m : i] == other[o - m : o] else (a, m - 1)
        c, d = 0, right
        while c < d:
            m = (c + d + 1) // 2
            c, d = (m, d) if text[i : i + m] == other[o : o + m] else (c, m - 1)
        return i - a, i + c

    @staticmethod
    def _equal(words: list[bytes], lo: int, hi: int, other: list[bytes], at: int) -> list[tuple[int, int]]:
        """The parts of words[lo:hi] that are equal to ``other`` from ``at`` on, byte by byte."""
        if words[lo:hi] == other[at : at + hi - lo]:
            return [(lo, hi)]
        same = np.fromiter((a == b for a, b in zip(words[lo:hi], other[at : at + hi - lo])), bool, hi - lo)
        return [(lo + a, lo + b) for a, b in flagged(same)]


def located(rows: DataFrame) -> DataFrame:
    """uid, first, end: marked words. ``rows``: shard, part, kind (0 for passages, 1 for pieces), uid, base, words; passages come first."""

    def marks(uid: int, base: int, flags: np.ndarray) -> list[tuple[int, int, int]]:
        return [(uid, base + a, base + b) for a, b in flagged(flags)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, machine, letters = None, [], None, _Letters()
        for batch in batches:
            out = []
            for shard, part, kind, uid, base, words in zip(batch["shard"], batch["part"], batch["kind"], batch["uid"], batch["base"], batch["words"]):
                if (shard, part) != held:
                    out += remembered(machine)
                    held, waiting, machine = (shard, part), [], None
                if kind == 0:
                    waiting.append((uid, base, words))
                    continue
                if machine is None:
                    machine = Automaton(waiting, letters)
                split = words.split(b" ")
                flags = np.zeros(len(split), bool)
                for x, y in machine.stretches(uid, base, split):
                    flags[x:y] = True
                out += marks(uid, base, flags)
            yield frame(out)
        yield frame(remembered(machine))

    def remembered(machine: Automaton | None) -> list[tuple[int, int, int]]:
        return [m for (uid, base), flags in zip(machine.at, machine.covered) for m in marks(uid, base, flags)] if machine else []

    def frame(out: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["uid", "first", "end"]).astype("int64")

    return rows.mapInPandas(run, "uid long, first long, end long")


def recurring_words(texts: DataFrame) -> DataFrame:
    """uid, first, end: stretches of words that recur."""
    every, recurring = candidates(texts)
    total = recurring.agg(F.sum(F.col("last") - F.col("first") + LENGTH)).first()[0] or 0
    shards = F.lit(max(1, total // SHARD_WORDS))
    shard = lambda uid, piece: F.pmod(F.xxhash64(uid, piece), shards).alias("shard")
    span = F.col("span")
    # A run goes where the representatives of its windows are, unless it is the representative itself.
    runs = every.select("name", "whole", "uid", first_window(span).alias("own_first"), last_window(span).alias("own_last"))
    needs = recurring.distinct().join(runs, ["name", "whole"]).where("uid <> rep or first < own_first or first > own_last")
    sent = needs.select("uid", "own_first", "own_last", "rep", _pieces(F.col("first"), F.col("last")).alias("rep_piece"))
    sent = sent.select("uid", shard("rep", "rep_piece"), _pieces(F.col("own_first"), F.col("own_last")).alias("piece")).distinct()
    sent = settle(sent, "sent")
    parts = sent.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_PIECES).alias("parts"))
    routed = sent.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("uid", "piece"), F.col("parts"))).drop("parts")
    compiled = passages(texts, recurring).withColumn("shard", shard("uid", "piece")).join(parts, "shard")
    copies = compiled.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = ["shard", "part", "kind", "uid", "base", "words"]
    both = copies.withColumn("kind", F.lit(0)).select(columns).unionByName(pieces(texts, routed).withColumn("kind", F.lit(1)).select(columns))
    return settle(located(both.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")), "marks")


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay with one space between them).

    Words are what stands between the characters 9 to 13 and 32. Defined cases: null and empty texts,
    and those of separators only, have no words; under ``LENGTH`` words nothing is removed; repeats
    within a text count like those across texts, overlapping ones too; rows that repeat, ids
    included, are elsewhere to each other; texts of any length are judged whole; an empty table gives
    no rows; further columns are never read.
    """
    texts = store(docs, id_col, text)
    marks = recurring_words(texts).groupBy("uid").agg(F.collect_list(F.struct("first", "end")).alias("marks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, z, found in zip(batch["doc_id"], batch["z"], batch["marks"]):
                words = _unpacked(z)
                flags = np.zeros(len(words), bool)
                for m in found if found is not None else ():
                    flags[m["first"] : m["end"]] = True
                kept = b" ".join([w for w, gone in zip(words, flags.tolist()) if not gone])
                out.append((doc_id, len(words), int(flags.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if with_text else [])))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return texts.join(marks, "uid", "left").select("doc_id", "z", "marks").mapInPandas(run, schema)


#: The same by all windows.
ORACLE_SQL = f"""WITH d AS (SELECT ROW_NUMBER() OVER () AS uid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT uid, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
s AS (SELECT uid, start, string_agg(word, ' ' ORDER BY i) AS seq FROM (SELECT uid, word, i, unnest(range(greatest(1, i - {LENGTH - 1}), least(i, n - {LENGTH - 1}) + 1)) AS start FROM w WHERE n >= {LENGTH}) x GROUP BY uid, start),
r AS (SELECT uid, start FROM s QUALIFY COUNT(*) OVER (PARTITION BY seq) > 1),
m AS (SELECT w.uid, w.i, w.word, MAX(r.start) OVER (PARTITION BY w.uid ORDER BY w.i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM w LEFT JOIN r ON r.uid = w.uid AND r.start = w.i),
k AS (SELECT uid, CAST(COUNT(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY uid)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (uid)"""
