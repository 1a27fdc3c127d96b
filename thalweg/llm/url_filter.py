"""URL filters: rules first, then naive Bayes over words of the host and the path.

Words run together in host names are split by a unigram Viterbi search, with the counts of all words
in the text of all pages. The counts stay in Spark: the substrings of the distinct parts of host names
are joined with them, and each part is split once, with the counts that it met. URLs that a rule judges teach a multinomial naive Bayes model, in a hashed table
of fixed size, which judges the rest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

ALLOW, BLOCK = "allow", "block"
RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)
SLOTS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PART = re.compile(r"[^\W_]+")


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (a host and its subdomains, paths by their start), and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def dictionary(texts: DataFrame, column: str) -> DataFrame:
    """word and n of every word of every whole text."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?s)<[^>]*>", " "))
    return texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@dataclass
class Segmenter:
    """Splits a name into the words of the highest product of unigram probabilities; unknown stretches cost more the longer they are."""

    counts: dict[str, int]
    total: int

    def cost(self, word: str) -> float:
        n = self.counts.get(word)
        return -math.log(n / self.total) if n else math.log(max(self.total, 1)) + 2.5 * len(word)

    def split(self, name: str) -> list[str]:
        """Known words end where they occur, whatever their length; of unknown stretches the cheapest start is carried along."""
        best, back = [0.0], [0]
        lengths = sorted({len(w) for w in self.counts})
        unknown, low = (0.0, 0), math.log(max(self.total, 1))
        for end in range(1, len(name) + 1):
            found = [(unknown[0] + low + 2.5 * end, unknown[1])]
            for n in lengths:
                if n > end:
                    break
                if name[end - n : end] in self.counts:
                    found.append((best[end - n] + self.cost(name[end - n : end]), end - n))
            c, b = min(found)
            best.append(c)
            back.append(b)
            unknown = min(unknown, (c - 2.5 * end, end))
        out, at = [], len(name)
        while at:
            out.append(name[back[at] : at])
            at = back[at]
        out.reverse()
        return out


def tokens(host_words: list[str], path: str) -> list[str]:
    """Words of the host and of the path, marked by where they stand; numbers are one token."""
    return ["h:" + w for w in host_words] + ["p:" + ("#" if part.isdigit() else part) for part in _PART.findall(path.lower())]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(h, i, p) for h in b["host"] for i, p in enumerate(_PART.findall(h))], columns=["host", "place", "part"])


def _substrings(names: DataFrame, lengths: list[int]) -> DataFrame:
    """part and word: the different substrings of each name (``part``) that are as long as some word of the dictionary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[str, str]] = []
        for b in batches:
            for p in b["part"]:
                for n in lengths:
                    if n > len(p):
                        break
                    rows += [(p, w) for w in {p[i : i + n] for i in range(len(p) - n + 1)}]
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=["part", "word"])
                        rows = []
        yield pd.DataFrame(rows, columns=["part", "word"])

    return names.mapInPandas(run, "part string, word string")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and its words, in order, of every distinct host that has any; ``counts`` are all words (word, n)."""
    counts = settle(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = settle(hosts.select("host").distinct().mapInPandas(_parts, "host string, place int, part string"), "parts")
    names = settle(parts.select("part").distinct(), "names")
    # Lengths of words, no longer than the longest name: as many numbers as that has letters, at most.
    longest = names.agg(F.max(F.length("part"))).first()[0] or 0
    lengths = sorted(r["n"] for r in counts.select(F.length("word").alias("n")).where(F.col("n") <= longest).distinct().collect())
    met = _substrings(names, lengths).join(counts, "word").groupBy("part").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            split = [["#"] if p.isdigit() else Segmenter(dict(zip(k, n)) if k is not None else {}, total).split(p) for p, k, n in zip(b["part"], b["known"], b["counts"])]
            yield pd.DataFrame({"part": b["part"], "words": split})

    split = names.join(met, "part", "left").mapInPandas(run, "part string, words array<string>")
    inside = F.sort_array(F.collect_list(F.struct("place", "words")))
    return parts.join(split, "part").groupBy("host").agg(F.flatten(F.transform(inside, lambda x: x["words"])).alias("words"))


def slot(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) % SLOTS


@dataclass
class Bayes:
    """Log odds (block against allow) of each slot, with add-one smoothing, and of the classes."""

    odds: np.ndarray
    prior: float

    @classmethod
    def of(cls, counts: np.ndarray, documents: tuple[int, int]) -> Bayes:
        """``counts``: (allow, block) x slots; without examples of a class the other one's verdict holds, without any: allow."""
        if 0 in documents:
            return cls(np.zeros(SLOTS), 50.0 if documents[1] else -50.0)
        smooth = counts + 1.0
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        return cls(logs[1] - logs[0], math.log(documents[1] / documents[0]))

    def score(self, slots: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.prior + float(self.odds[slots].sum())))))


def told(rules) -> frozenset[str]:
    """The rules' own tokens. They say which rule judged an example, not what it is like, so the model never sees them."""
    split = [text.partition("/") for text, _ in rules]
    return frozenset({f"h:{x}" for name, _, _ in split for x in _PART.findall(name)} | {f"p:{x}" for _, _, rest in split for x in _PART.findall(rest)})


def train(judged: DataFrame, hidden: frozenset[str] = frozenset()) -> Bayes:
    """From rows with words, path and verdict, without ``hidden`` tokens; the counts that reach the driver are 2 x ``SLOTS`` whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = np.zeros((2, SLOTS + 1), np.int64)
            for words, path, verdict in zip(b["words"], b["path"], b["verdict"]):
                k = int(verdict == BLOCK)
                counts[k, SLOTS] += 1
                for t in tokens(words, path):
                    if t not in hidden:
                        counts[k, slot(t)] += 1
            k, at = np.nonzero(counts)
            yield pd.DataFrame({"k": k, "at": at, "n": counts[k, at]})

    got = judged.select("words", "path", "verdict").mapInPandas(run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SLOTS + 1))
    for r in got:
        counts[r["k"], r["at"]] = r["n"]
    return Bayes.of(counts[:, :SLOTS], (int(counts[0, SLOTS]), int(counts[1, SLOTS])))


def _worded(pages: DataFrame, rules, words_from: str) -> DataFrame:
    """page_id, host, path, rule, by_rule (the rule's verdict) and the host's words."""
    host, path = host_of(), path_of()
    rule, verdict = rule_of(host, path, rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("by_rule"))
    words = host_words(rows, dictionary(pages, words_from))
    return settle(rows.join(words, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))), "urls")


def _scored(rows: DataFrame, model: Bayes, hidden: frozenset[str]) -> DataFrame:
    """Rows with verdict, score and host_words (joined by spaces) for by_rule and words."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 2 x ``SLOTS`` numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bayes = shared.value
            found = [[t for t in tokens(w, p) if t not in hidden] for w, p in zip(b["words"], b["path"])]
            scores = [bayes.score([slot(t) for t in ts]) for ts in found]
            verdicts = [r if isinstance(r, str) else (BLOCK if s > 0.5 else ALLOW) for r, s in zip(b["by_rule"], scores)]
            yield b.drop(columns=["by_rule", "words"]).assign(verdict=verdicts, score=scores, host_words=[" ".join(w) for w in b["words"]])

    return rows.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, score double, host_words string")


def held_out(pages: DataFrame, rules=RULES, words_from: str = "html") -> tuple[float, int]:
    """(share of right verdicts, urls): the model on hosts that it has not learnt from, against the rules' verdicts."""
    rows = _worded(pages, rules, words_from).where("by_rule is not null")
    kept = F.pmod(F.crc32("host"), F.lit(5)) == 0
    hidden = told(rules)
    model = train(rows.where(~kept).withColumnRenamed("by_rule", "verdict"), hidden)
    judged = _scored(rows.where(kept).withColumn("rule", F.col("by_rule")).withColumn("by_rule", F.lit(None).cast("string")), model, hidden)
    got = judged.agg(F.avg((F.col("verdict") == F.col("rule")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    return got["right"] or 0.0, got["n"]


def judge(pages: DataFrame, rules=RULES, words_from: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block by the model) and host_words of every url.

    Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule and get
    the model's verdict on no token; equal rows get equal answers; with nothing judged by rules the
    model says allow; pages without text give an empty dictionary, hosts then stay whole; an empty
    table gives no rows; further columns are never read.
    """
    rows, hidden = _worded(pages, rules, words_from), told(rules)
    return _scored(rows, train(rows.where("by_rule is not null").withColumnRenamed("by_rule", "verdict"), hidden), hidden)
