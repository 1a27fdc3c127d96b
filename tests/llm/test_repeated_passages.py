import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import repeated_passages as rp
from thalweg.llm import textbytes


def brute(texts):
    """Per text (bytes): number removed, spans and digest, from a set of all windows."""
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            w = t[i : i + 200]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(c for c, g in zip(t, gone[1:-1]) if not g)
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rp.remove(df).collect()}
    want = brute([(t or "").encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    alphabet = "abcdefgh é"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (198, 199, 200, 201, 230, 400, 900)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(text(rng.randrange(0, 400)))
            if rng.random() < 0.7:
                s = rng.choice(shared)
                if rng.random() < 0.4:  # a near copy
                    at = rng.randrange(len(s))
                    s = s[:at] + "Z" + s[at + 1 :]
                if rng.random() < 0.3:
                    s = s[rng.randrange(20) :]
                parts.append(s)
        out.append("".join(parts))
    return [*out, None, "", "x" * 150, "y" * 700, "ab" * 300, "abc " * 90, out[0], out[0]]


def test_against_brute_force(spark, texts):
    check(spark, texts)


def test_long_text_in_small_chunks(spark, texts, monkeypatch):
    monkeypatch.setattr(textbytes, "CHUNK", 700)
    check(spark, [*texts[:20], "".join(t or "" for t in texts[:30])])


def test_small_documents(spark, small_docs):
    rows = small_docs.orderBy("doc_id").limit(120).collect()
    check(spark, [r["text"] for r in rows])


def test_empty_and_clashing_columns(spark, make_docs):
    docs = make_docs(["q" * 300, None]).withColumn("uid", F.lit("x")).withColumn("z", F.lit(1)).withColumn("span", F.lit(2))
    assert {r["doc_id"]: r["n_removed"] for r in rp.remove(docs).collect()} == {0: 300, 1: 0}
    assert rp.remove(docs.limit(0)).count() == 0
    twice = rp.remove(make_docs(["".join(chr(97 + i * i % 23) + str(i) for i in range(120))]).withColumn("doc_id", F.explode(F.array(F.lit(5), F.lit(5)))))
    assert [r["n_spans"] for r in twice.collect()] == [1, 1]
