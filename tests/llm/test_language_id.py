import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import language_id as lid
from thalweg.llm import textbytes

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SF)


def test_held_out_accuracy(docs):
    got = lid.identify(docs, rows_per_language=150).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == list(got.held_out)
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.accepted.mean() > 0.99


def test_hard_cases(spark, make_docs, docs):
    model = lid.train(docs, 60)
    odd = make_docs([None, "", "123 !!", "é", "the " * 700_000]).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in lid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert not got[0]["accepted"] and got[0]["score"] == 0.0
    assert got[4]["lang_pred"] == "en"
    assert lid.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in lid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = lid.drop_rejected(make_docs([None, "77"] + [r["text"] for r in docs.where("lang = 'en'").limit(30).collect()] ), 60)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.where("doc_id < 2").count() == 0 and kept.count() == 30


def test_chunks_agree_with_plain_sum(monkeypatch, docs):
    model = lid.train(docs, 40)
    texts = ["the cat and the dog", "", None, "le chat et la souris été", "x" * 5000, "der hund"]
    whole = model.probabilities(texts)
    monkeypatch.setattr(textbytes, "CHUNK", 64)
    assert np.allclose(whole, model.probabilities(texts), atol=1e-6)
    for t in ("the cat", "le chat été"):
        at, n = lid.counts(t)
        z = ((n / n.sum()) @ model.weights[at] + model.bias) / model.temperature
        p = np.exp(z - z.max())
        assert np.allclose(p / p.sum(), model.probabilities([t])[0], atol=1e-6)


def test_learns_only_from_the_other_rows(docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    wrong = docs.withColumn("lang", F.when(held, F.lit("en")).otherwise(F.col("lang")))
    a, b = lid.train(docs, 40), lid.train(wrong, 40)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_two_samples_are_told_apart(spark, make_docs):
    rows = [(1, "the cat sat on the mat and the dog ran away", "en", "s", 1), (4, "le chat est sur la table et le chien est parti", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = lid.train(docs, split=None)
    p = model.probabilities([r[1] for r in rows])
    assert [model.languages[k] for k in p.argmax(axis=1)] == ["en", "fr"]
