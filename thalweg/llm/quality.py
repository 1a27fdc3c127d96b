"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (shares of byte
classes, word statistics, repeats, a hashed histogram of byte trigrams); a learned layer embeds
it; gated attention weighs the passages of a document, and a logistic unit scores the weighted
mean. Only document labels are used. The model is fitted in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import encode

PASSAGE = 100
HASHED = 48
STATS = 20
WIDTH = STATS + HASHED
HIDDEN = 24
#: Bound of the sample of labelled rows: about so many of each label.
ROWS_PER_LABEL = 1500
#: A fitted document has at most so many bytes encoded at once; longer ones are encoded slice by slice.
SLICE = 1 << 20

_SPACE, _UPPER, _LOWER, _DIGIT, _POINT, _OTHER, _HIGH = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_CLASS[48:58] = _DIGIT
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = _POINT
_CLASS[128:] = _HIGH


def _slices(t: bytes) -> Iterator[bytes]:
    """A text in slices of about ``SLICE`` bytes that end at white space where there is any."""
    at = 0
    while at < len(t):
        end = min(len(t), at + SLICE)
        if end < len(t):
            cut = max(t.rfind(b" ", at, end), t.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield t[at:end]
        at = end


def encode_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH, bag of each passage); a text without a word is one passage of zeros."""
    feats, bags = [np.zeros((0, WIDTH), np.float32)], [np.zeros(0, np.int64)]
    group: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, owner, size
        if group:
            f, o = _passages(group, owner)
            feats.append(f)
            bags.append(o)
        group, owner, size = [], [], 0

    for i, t in enumerate(texts):
        b = encode(t)
        if not b.strip(b" \t\n\x0b\x0c\r"):
            feats.append(np.zeros((1, WIDTH), np.float32))
            bags.append(np.array([i]))
            continue
        for piece in _slices(b):
            if size + len(piece) > 2 * SLICE:
                flush()
            group.append(piece)
            owner.append(i)
            size += len(piece) + 1
    flush()
    bag = np.concatenate(bags)
    order = np.argsort(bag, kind="stable")
    return np.concatenate(feats)[order], bag[order]


def _passages(group: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    kind = _CLASS[b]
    space = kind == _SPACE
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    if not len(start):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    lens = np.fromiter(map(len, group), np.int64, len(group)) + 1
    part = np.searchsorted(np.cumsum(lens), start, side="right")
    first = np.concatenate([[True], part[1:] != part[:-1]])
    nth = np.arange(len(start)) - np.maximum.accumulate(np.where(first, np.arange(len(start)), 0))
    head = np.flatnonzero(first | (nth % PASSAGE == 0))  # first word of each passage
    words = np.diff(np.append(head, len(start)))
    # A passage's bytes run up to the next one's first word, and no further than its own text.
    close = np.cumsum(lens)[part[head]]
    lo = start[head]
    hi = np.minimum(np.append(lo[1:], len(b)), close)
    span = (hi - lo).astype(np.float64)
    size = (end - start).astype(np.float64)
    with np.errstate(over="ignore"):
        key = (b[start].astype(np.uint64) << np.uint64(40)) ^ (b[end - 1].astype(np.uint64) << np.uint64(32)) ^ size.astype(np.uint64)
        # A sum over the bytes does not depend on the place, so equal words have equal keys.
        plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b.astype(np.uint64) * b.astype(np.uint64) * np.uint64(2654435761))])
        key ^= (plain[end] - plain[start]) << np.uint64(8)
    per_word = lambda x: np.add.reduceat(x.astype(np.float64), head) / words
    # Distinct words of a passage: first rows of (passage, key) in sorted order.
    passage = np.repeat(np.arange(len(head)), words)
    order = np.lexsort((key, passage))
    k, p = key[order], passage[order]
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
    distinct = np.bincount(p[fresh], minlength=len(head)) / words
    same = np.concatenate([[False], key[1:] == key[:-1]]) & ~first

    def within(flags: np.ndarray) -> np.ndarray:
        """How many of a passage's bytes are flagged."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[hi] - sums[lo]).astype(np.float64)

    of = lambda c: within(kind == c) / span
    shares = [of(c) for c in (_SPACE, _UPPER, _LOWER, _DIGIT, _POINT, _OTHER, _HIGH)]
    last, begin = kind[end - 1], kind[start]
    mean = per_word(size)
    byte = lambda c: within(b == ord(c)) / words
    stats = np.stack(
        [
            *shares,
            np.log1p(words) / 5,
            mean / 10,
            np.sqrt(np.maximum(per_word(size**2) - mean**2, 0)) / 10,
            distinct,
            per_word(same),
            per_word(last == _OTHER),
            per_word(last == _POINT),
            per_word(begin == _UPPER),
            per_word(begin == _OTHER),
            byte("\n"),
            byte("!"),
            byte("|"),
            byte("."),
        ],
        axis=1,
    )
    w = b.astype(np.uint32)
    w[kind == _DIGIT] = 48
    slot = ((w[:-2] | w[1:-1] << 8 | w[2:] << 16) * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(HASHED)
    # Three bytes count for the passage that they begin in, if they end in its text.
    at = np.arange(len(slot))
    which = (np.searchsorted(lo, at, side="right") - 1).clip(0)
    inside = (at >= lo[which]) & (at < hi[which]) & (at + 2 < close[which])
    hist = np.bincount(which[inside] * HASHED + slot[inside], minlength=len(head) * HASHED).reshape(-1, HASHED)
    return np.concatenate([stats, np.sqrt(hist / span[:, None])], axis=1).astype(np.float32), np.array(owner, np.int64)[part[head]]


@dataclass
class Model:
    """Parameters: encoder V, attention A (tanh) and B (gate) with vector w, output c and bias."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, bag = encode_texts(texts)
        return self.forward((x - self.mean) / self.scale, bag, len(texts))[0]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        p = self.params
        h = np.tanh(x @ p["V"] + p["v"])
        t, g = np.tanh(h @ p["A"]), 1 / (1 + np.exp(-(h @ p["B"])))
        e = (t * g) @ p["w"]
        # Softmax of each bag.
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return score, (h, t, g, a, z)

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        score, (h, t, g, a, z) = self.forward(x, bag, len(y))
        d = (score - y) * weight / weight.sum()
        dz = d[:, None] * p["c"]
        # Through the attention: the softmax's own mean comes off.
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.bincount(bag, a * da, len(y))[bag])
        dt, dg = de[:, None] * g * p["w"] * (1 - t**2), de[:, None] * t * p["w"] * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["A"].T + dg @ p["B"].T
        dh *= 1 - h**2
        return {"V": x.T @ dh, "v": dh.sum(axis=0), "A": h.T @ dt, "B": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "b": np.array(d.sum())}


def fit(bags: list[np.ndarray], labels: list[int], epochs: int = 30, size: int = 64, rate: float = 0.01, seed: int = 11) -> Model:
    """Adam on bags of encoded passages; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.zeros((0, WIDTH), np.float32), *bags])
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    model = Model(mean, scale, {"V": draw(WIDTH, HIDDEN), "v": np.zeros(HIDDEN), "A": draw(HIDDEN, HIDDEN), "B": draw(HIDDEN, HIDDEN), "w": draw(HIDDEN), "c": draw(HIDDEN), "b": np.array(0.0)})
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:  # nothing to tell apart: the label there is, or one half
        model.params["c"][:] = 0
        model.params["b"] = np.array(0.0 if not len(y) else 4.0 * (2 * y[0] - 1))
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    scaled = [(b - mean) / scale for b in bags]
    m = {k: np.zeros_like(v) for k, v in model.params.items()}
    s = {k: np.zeros_like(v) for k, v in model.params.items()}
    step = 0
    total = epochs * -(-len(y) // size)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            chosen = order[at : at + size]
            bag = np.repeat(np.arange(len(chosen)), [len(scaled[i]) for i in chosen])
            grads = model.gradients(np.concatenate([scaled[i] for i in chosen]), bag, y[chosen], weight[chosen])
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, gr in grads.items():
                gr = gr + 1e-4 * model.params[k]
                m[k] = 0.9 * m[k] + 0.1 * gr
                s[k] = 0.999 * s[k] + 0.001 * gr**2
                model.params[k] = model.params[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, split: tuple[int, int] | None = (3, 1)) -> Model:
    """Fit on labelled rows; of a ``split`` (m, r), rows with crc32(doc_id) mod m = r are left out.

    The sample is bounded: of each label the rows whose id hashes under a share that gives about
    ``rows_per_label`` rows. Encoded passages, not texts, go to the driver.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y")).distinct()
    if split:
        known = known.where(F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(split[0])) != split[1])
    sizes = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("__y") == y, F.lit(min(1.0, rows_per_label / n))).otherwise(share)
    known = known.where(F.pmod(F.xxhash64("__id", F.lit("quality")), F.lit(1_000_000)) < share * 1_000_000)
    # The sample's ids are some thousands whatever the corpus: texts are filtered where they are read.
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(known), "__id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, bag = encode_texts([t if isinstance(t, str) else None for t in b["__text"]])
            cuts = np.searchsorted(bag, np.arange(len(b) + 1))
            yield pd.DataFrame({"i": b["__id"].to_numpy(), "y": b["__y"].to_numpy(), "x": [x[a:c].astype(np.float16).tobytes() for a, c in zip(cuts, cuts[1:])]})

    got = rows.mapInPandas(run, "i long, y int, x binary").toPandas().sort_values(["i", "y"])
    return fit([np.frombuffer(x, np.float16).astype(np.float32).reshape(-1, WIDTH) for x in got["x"]], [int(y) for y in got["y"]])


def classify(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Defined cases: null, empty and white-space texts are a bag of one blank passage and get its
    score; a text of any length is encoded whole, slice by slice; labels other than 0 and 1 are
    passed over; with one label or none every score is that label's or 0.5; repeated ids give
    repeated rows; an empty table gives no rows; further columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows_per_label))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shared.value.scores([t if isinstance(t, str) else None for t in b["__text"]]) if len(b) else []
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s})

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    return ids.mapInPandas(run, "doc_id long, score double").select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
