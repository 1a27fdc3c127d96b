"""Best-fit packing of tokenised documents into sequences by a distributed grouping genetic algorithm.

Documents are tokenised and cut into pieces. Pieces shorter than a sequence are dealt by hash into
shards of bounded size. A shard is worked on by several islands, each a group of its own with its
own population: crossover injects whole well-filled bins of one parent into another, bins that hold
an injected piece are dissolved, and the displaced pieces go back best-fit. Between epochs an
island's elite migrates, through a shuffle, to the next island of the shard. Pieces of bins that
stay poorly filled are dealt anew, across all shards, for a second round.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import settle

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard, islands of a shard, individuals of an island, crossovers of an epoch.
SHARD = 4000
ISLANDS = 2
POPULATION = 4
CROSSOVERS = 24
EPOCHS = 2
#: Bins filled under this share are dissolved after the first round.
WELL_FILLED = 0.97
# The word pattern of the tokenizer file, with white space spelt out for texts below U+0300.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
#: Stands for the end of a word; texts that hold it are left to the tokenizer.
_END = "\x00"
_workers: dict[str, "Words"] = {}


class Words:
    """Token ids of texts. The file's vocabulary and merges run in a faster library where texts are plain.

    A byte-pair merge with a rank for each result gives the file's ids: its base tokens come first,
    with and without the end of word, then its merges in order, no two of which give one token.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        split = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        #: Another file's words or letters may be cut in other ways: its texts all go through the tokenizer.
        self.plain = (
            (file.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and split.get("pattern") == {"Regex": _FILE_PATTERN}
            and (model.get("type"), model.get("end_of_word_suffix")) == ("BPE", "</w>")
        )
        if not self.plain:
            return
        letters = _byte_letters()
        end = _END.encode()

        def spelt(token: str) -> bytes:
            stem = token.removesuffix("</w>")
            return bytes(letters[c] for c in stem) + (end if stem != token else b"")

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(1, 256):
            ranks[bytes([b]) + end] = len(ranks)
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            if end not in spelt(left) and ranks.setdefault(spelt(left) + spelt(right), len(ranks)) != len(ranks) - 1:
                raise ValueError("two merges of this vocabulary give one token")
        self.merges = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.zeros(len(ranks), "<u4")
        for token, i in model["vocab"].items():
            if all(c in letters for c in token.removesuffix("</w>")) and spelt(token) in ranks:
                self.id_of[ranks[spelt(token)]] = i

    def ids(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text, as ``encode(text, add_special_tokens=False)`` gives them."""
        t = text or ""
        # Below U+0300 there is nothing to compose and lower-casing has one special case; that, a
        # special token's own text, and any other letter are left to the tokenizer.
        if self.plain and (t.isascii() or max(t) < "\u0300") and "<|" not in t and "\u0130" not in t and _END not in t:
            found = _WORDS.findall(t.lower())
            return self.id_of[self.merges.encode_ordinary(f"{_END} ".join(found) + _END)].tobytes() if found else b""
        return np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a row's own ``uid``; ids are a document's and then ``END_ID``."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _workers:
            _workers[tokenizer] = Words(tokenizer)
        words = _workers[tokenizer]
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["__text"]):
                ids = words.ids(text if isinstance(text, str) else None) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text")).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    return found.withColumn("uid", F.monotonically_increasing_id())


class Bins:
    """A packing: items of each bin, their fill, and the open room in order."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def place(self, items: list[int]) -> None:
        """Best fit, largest first."""
        self.place_in_order(sorted(items, key=lambda x: (-self.sizes[x], x)))

    def place_in_order(self, items: list[int]) -> None:
        """Each item goes to the open bin that it leaves the least room in, or to a new one."""
        room = sorted((self.capacity - f, i) for i, f in enumerate(self.fill) if f < self.capacity)
        for item in items:
            size = int(self.sizes[item])
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
                self.bins[k].append(item)
                self.fill[k] += size
                if left > size:
                    insort(room, (left - size, k))
            else:
                self.bins.append([item])
                self.fill.append(size)
                if size < self.capacity:
                    insort(room, (self.capacity - size, len(self.bins) - 1))

    def add(self, items: list[int]) -> None:
        self.bins.append(items)
        self.fill.append(int(self.sizes[items].sum()))

    def fitness(self) -> float:
        """Mean square fill: fewer bins, and of as many those with full and empty ones apart."""
        return float(np.mean((np.array(self.fill) / self.capacity) ** 2)) if self.fill else 1.0

    def labels(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int32)
        for i, items in enumerate(self.bins):
            out[items] = i
        return out


def from_labels(sizes: np.ndarray, labels: np.ndarray, capacity: int) -> Bins:
    made = Bins(sizes, capacity)
    order = np.argsort(labels, kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else []:
        made.add(items.tolist())
    return made


def cross(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """Well-filled bins of ``b`` go whole into ``a``; bins of ``a`` that share an item with them are dissolved.

    Some of the emptiest bins that are left are dissolved too; all displaced items go back by best fit.
    """
    ranked = np.argsort(-np.array(b.fill) + rng.random(len(b.fill)), kind="stable")
    take = ranked[: max(1, int(len(ranked) * rng.uniform(0.1, 0.5)))]
    child = Bins(a.sizes, a.capacity)
    inside = np.zeros(len(a.sizes), bool)
    for k in take:
        child.add(list(b.bins[k]))
        inside[b.bins[k]] = True
    displaced: list[int] = []
    kept: list[list[int]] = []
    for items in a.bins:
        hit = inside[items]
        if hit.any():
            displaced += [x for x, h in zip(items, hit) if not h]
        else:
            kept.append(items)
    kept.sort(key=lambda items: -int(a.sizes[items].sum()))
    weak = max(1, len(a.bins) // 20)
    for items in kept[: len(kept) - weak]:
        child.add(list(items))
    for items in kept[len(kept) - weak :]:
        displaced += items
    child.place(displaced)
    return child


def evolve(sizes: np.ndarray, elites: list[Bins], capacity: int, seed: int, population: int, crossovers: int) -> tuple[Bins, int]:
    """The best packing of the last generation, and how many children took another's place.

    A population starts from elites and from random groupings (items best-fitted in random order). A
    child takes the place of the worst; crossovers end early only where no packing can have fewer bins.
    """
    rng = np.random.default_rng(seed)
    people = list(elites)
    while len(people) < population:
        made = Bins(sizes, capacity)
        made.place_in_order(rng.permutation(len(sizes)).tolist())
        people.append(made)
    bound, accepted = -(-int(sizes.sum()) // capacity), 0
    people.sort(key=_rank)
    for _ in range(crossovers):
        if len(people[0].bins) <= bound:
            break
        i, j = rng.choice(len(people), 2, replace=False)
        child = cross(people[i], people[j], rng)
        if _rank(child) < _rank(people[-1]):
            people[-1] = child
            accepted += 1
            people.sort(key=_rank)
    return people[0], accepted


def _rank(packing: Bins) -> tuple[int, float]:
    return len(packing.bins), -packing.fitness()


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, seed: int = 3, epochs: int = EPOCHS) -> DataFrame:
    """uid, shard, bin and fill for ``items`` (uid, length < capacity), and the crossovers accepted on the
    shard's best island in the last epoch."""
    n = items.count()
    shards = max(1, -(-n // shard))
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"))
    state = dealt.select("*", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(None).cast("int").alias("bin"), F.lit(False).alias("migrant"))
    schema = "uid long, length long, shard int, island int, bin int, migrant boolean, fill long, fitness double, accepted int"

    def island(epoch: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            own = group[~group["migrant"]].sort_values("uid")
            sizes = own["length"].to_numpy(np.int64)
            elites = []
            for part in (own, group[group["migrant"]].sort_values("uid")):
                if len(part) and part["bin"].notna().all():
                    elites.append(from_labels(sizes, part["bin"].to_numpy(np.int32), capacity))
            where = int(own["shard"].iat[0]), int(own["island"].iat[0])
            best, accepted = evolve(sizes, elites, capacity, hash((seed, epoch, *where)) & 0xFFFFFFFF, POPULATION, CROSSOVERS)
            bins = best.labels()
            return pd.DataFrame({"uid": own["uid"].to_numpy(), "length": sizes, "shard": where[0], "island": where[1], "bin": bins, "migrant": False, "fill": np.array(best.fill, np.int64)[bins], "fitness": best.fitness() - len(best.bins), "accepted": accepted})

        return run

    for epoch in range(epochs):
        state = settle(state.groupBy("shard", "island").applyInPandas(island(epoch), schema), "island")
        if epoch < epochs - 1:
            columns = ("uid", "length", "shard", "island", "bin", "migrant")
            gone = state.withColumn("island", (F.col("island") + 1) % islands).withColumn("migrant", F.lit(True))
            state = state.select(*columns).unionByName(gone.select(*columns))
    best = state.groupBy("shard").agg(F.max_by("island", F.struct("fitness", -F.col("island"))).alias("island"))
    return state.join(best, ["shard", "island"]).select("uid", "length", "shard", "bin", "fill", "accepted")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    Defined cases: null and empty texts are the end id alone; a longer document is cut at each
    ``capacity`` ids, other documents are never cut; repeated ids give repeated pieces, each packed;
    an empty table gives no rows; further columns are never read.
    """
    cut = settle(pieces(docs, tokenizer, capacity), "pieces")
    # A full piece is a sequence; negative numbers are theirs.
    full = cut.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"))
    rest = cut.where(F.col("length") < capacity).select("uid", "length")
    number = lambda r: F.lit(r << 60) + F.col("shard").cast("long") * F.lit(1 << 24) + F.col("bin")
    first = settle(pack(rest, capacity, shard), "packed")
    good = first.where(F.col("fill") >= WELL_FILLED * capacity)
    poor = first.where(F.col("fill") < WELL_FILLED * capacity).select("uid", "length")
    second = pack(poor, capacity, shard, seed=5)
    placed = full.unionByName(good.select("uid", number(0).alias("sequence_id"))).unionByName(second.select("uid", number(1).alias("sequence_id")))
    # At most ``capacity`` pieces share a sequence: the window is bounded.
    rows = cut.join(placed, "uid").withColumn(
        "offset", F.expr("sum(length) over (partition by sequence_id order by uid rows between unbounded preceding and current row) - length")
    )
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
