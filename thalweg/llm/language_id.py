"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte 3- and 4-grams (ASCII letters lower-cased,
other ASCII read as a space); a linear layer and a softmax give the language. Embeddings and layer
are learned by stochastic gradient descent in numpy on a bounded sample; a temperature and a
rejection threshold are then fitted on a part of the sample kept back for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .textbytes import chunks, encode

#: log2 of the number of hash slots, and the width of an embedding.
SLOT_BITS = 15
WIDTH = 16
#: Bound of the sample that the model is fitted on: about so many rows of each language.
ROWS_PER_LANGUAGE = 1500
UNKNOWN = "und"
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _slots(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the 3- and 4-grams that start at each byte."""
    w = b.astype(np.uint32)
    three = w[:-2] | w[1:-1] << 8 | w[2:] << 16
    four = three[:-1] | w[3:] << 24
    shift = np.uint32(32 - SLOT_BITS)
    return (three * np.uint32(2654435761) >> shift).astype(np.int32), (four * np.uint32(2246822519) >> shift).astype(np.int32)


def _prepared(text: str | None) -> bytes:
    return b" " + encode(text).translate(_SPACED) + b"   "


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and how often each occurs; a text of any length is at most 2 ** SLOT_BITS pairs."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for b, *_ in chunks([_prepared(text)], 3):
        for s in _slots(b):
            total += np.bincount(s, minlength=len(total))
    at = np.flatnonzero(total)
    return at.astype(np.uint16), total[at].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages: embeddings times layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        n, k = len(texts), len(self.languages)
        sums, size = np.zeros((n, k)), np.zeros(n)
        for b, starts, owners, _ in chunks((_prepared(t) for t in texts), 3):
            ends = np.append(starts[1:], len(b))
            for order, s in zip((3, 4), _slots(b)):
                # Windows that would run into the next text count for none of them.
                w = self.weights[s]
                for back in range(1, order):
                    at = ends - back
                    w[at[at < len(w)]] = 0
                s0 = np.minimum(starts, len(w) - 1)
                np.add.at(sums, owners, np.add.reduceat(w, s0, axis=0, dtype=np.float64))
                np.add.at(size, owners, np.maximum(ends - starts - order + 1, 0))
        logits = (sums / np.maximum(size, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 4, least_steps: int = 8000, rate: float = 0.25, seed: int = 7) -> Model:
    """``samples``: (slots, counts). Every fifth sample is kept back for temperature and threshold; of
    fewer than 50 all are learnt from and calibrated on. Small samples are gone over more often."""
    languages = sorted(set(labels))
    if not languages:
        return Model([UNKNOWN], np.zeros((1 << SLOT_BITS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << SLOT_BITS, WIDTH))
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(samples))
    held, used = (order[::5], np.delete(order, np.s_[::5])) if len(order) >= 50 else (order, order)
    epochs = max(epochs, -(-least_steps // max(1, len(used))))
    steps, done = epochs * max(1, len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            slots, n = samples[i]
            share = n / n.sum()
            x = share @ emb[slots]
            z = x @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = rate * (1 - done / steps)
            back = layer @ p
            layer -= step * np.outer(x, p)
            bias -= 0.1 * step * p
            emb[slots] -= step * np.outer(share * len(slots) ** 0.5, back)
            done += 1
    weights = emb @ layer
    z = np.array([(samples[i][1] / samples[i][1].sum()) @ weights[samples[i][0]] + bias for i in held])

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]).mean())

    temperature = min(np.geomspace(0.02, 50, 160), key=loss)
    s = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    s /= s.sum(axis=1, keepdims=True)
    right = s.max(axis=1)[s.argmax(axis=1) == y[held]]
    # Of what is predicted rightly, at most one in a thousand is to be rejected.
    threshold = min(0.5, float(np.quantile(right, 0.001))) if len(right) else 0.0
    return Model(languages, weights.astype(np.float32), bias, float(temperature), threshold)


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, split: tuple[int, int] | None = (4, 2)) -> Model:
    """Fit on rows with a language and a text; of a ``split`` (m, r), rows with crc32(doc_id) mod m = r are left out.

    The sample is bounded: of each language every row whose id hashes under a share that gives
    about ``rows_per_language`` rows. Its slot counts, not its texts, go to the driver.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    if split:
        rows = rows.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(split[0])) != split[1])
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_language / n))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_letter(t) for t in b["text"]]]
            found = [counts(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "lang": b["lang"].to_numpy(), "slots": [s.tobytes() for s, _ in found], "n": [n.tobytes() for _, n in found]})

    got = chosen.mapInPandas(run, "doc_id long, lang string, slots binary, n binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    # Views of the collected buffers, which are given back once the model is fitted.
    samples = [(np.frombuffer(s.as_buffer(), np.uint16), np.frombuffer(n.as_buffer(), np.float32)) for s, n in zip(got["slots"], got["n"])]
    model = fit(samples, got["lang"].to_pylist())
    del samples, got
    pa.default_memory_pool().release_unused()
    tidy(docs.sparkSession)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** SLOT_BITS x languages floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["__text"]]
            p = m.probabilities(texts) if len(texts) else np.zeros((0, 1))
            best = p.argmax(axis=1) if len(texts) else []
            letters = [has_letter(t) for t in texts]
            out = b.drop(columns="__text")
            out["__lang"] = [m.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
            out["__score"] = [float(p[i, k]) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, letters))]
            yield out

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    found = ids.mapInPandas(run, "doc_id long, __lang string, __score double")
    return found.select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), ((F.col("__lang") != UNKNOWN) & (F.col("__score") >= model.threshold)).alias("accepted"))


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every document.

    Defined cases: null text, or one without a letter: ``und``, score 0, not accepted; no row to
    learn from: ``und`` for all; repeated ids give repeated rows; an empty table gives no rows;
    further columns are never read.
    """
    model = train(docs, rows_per_language)
    return predict(docs, model).select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).alias("held_out"),
        "lang_pred",
        "score",
        "accepted",
    )


def drop_rejected(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The documents whose language is recognised; columns as they came.

    Null and empty texts, and those without a letter, go; where there is no row to learn from, all
    go; repeated rows stay or go together; an empty table gives no rows.
    """
    model = train(docs, rows_per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        m = shared.value
        texts = [t if isinstance(t, str) else None for t in text]
        if not texts:
            return pd.Series([], dtype=bool)
        p = m.probabilities(texts)
        ok = (p.max(axis=1) >= m.threshold) & np.array([has_letter(t) for t in texts]) & (m.languages != [UNKNOWN])
        return pd.Series(ok)

    return docs.where(accepted(F.col("text")))
