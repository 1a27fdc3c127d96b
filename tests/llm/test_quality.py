import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import quality as q


@pytest.fixture(scope="module")
def tables(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = q.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.quality == held.predicted).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_hard_cases(tables, make_docs):
    docs, labels = tables
    odd = make_docs([None, "", " \n\t", "word", "lone " * 400_000, "x" * 3_000_000]).withColumn("score", F.lit("x")).withColumn("quality", F.lit(9))
    got = {r["doc_id"]: r for r in q.classify(odd, labels).collect()}
    assert len(got) == 6 and got[0]["score"] == got[1]["score"] == got[2]["score"]
    assert q.classify(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in q.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert all(r["score"] > 0.9 for r in q.classify(docs.limit(20), labels.withColumn("quality", F.lit(1))).collect())


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, q.WIDTH)).astype(np.float32) for n in (1, 3, 5)]
    model = q.fit(bags * 3, [0, 1, 1] * 3, epochs=1)
    x, bag = np.concatenate(bags).astype(np.float64), np.array([0, 1, 1, 1, 2, 2, 2, 2, 2])
    y, weight = np.array([0.0, 1, 1]), np.array([1.0, 2, 1])

    def loss():
        s = model.forward(x, bag, 3)[0]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    grads = model.gradients(x, bag, y, weight)
    for name, at in (("V", (3, 2)), ("A", (1, 4)), ("B", (2, 2)), ("w", (5,)), ("c", (3,)), ("b", ())):
        kept = np.array(model.params[name])
        ends = []
        for step in (1e-5, -1e-5):
            moved = np.array(kept, np.float64)
            moved[at] += step
            model.params[name] = moved
            ends.append(loss())
        model.params[name] = kept
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[name][at]) < 1e-6


def test_passages_cover_the_text():
    text = " ".join(["alpha"] * 250) + "\n" + "beta! " * 30
    x, bag = q.encode_texts([text, None, "one"])
    assert list(np.bincount(bag)) == [3, 1, 1]
    assert x[1, 11] > 0.9  # repeats


def test_scores_against_a_plain_version(tables, monkeypatch):
    """Passage by passage and number by number: encoder, gated attention, softmax over the document, score."""
    docs, labels = tables
    model = q.train(docs, labels)
    monkeypatch.setattr(q, "train", lambda *_: model)
    p = {k: np.asarray(v, float).tolist() for k, v in model.params.items()}
    n = len(p["w"])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    some = docs.where("doc_id % 25 = 3")
    got = {r["doc_id"]: r["score"] for r in q.classify(docs, labels).join(some.select("doc_id"), "doc_id", "left_semi").collect()}
    for row in some.collect():
        passages = ((q.encode_texts([row["text"]])[0].astype(float) - model.mean) / model.scale).tolist()
        hidden, logit = [], []
        for x in passages:
            h = [np.tanh(dot(x, [v[j] for v in p["V"]]) + p["v"][j]) for j in range(n)]
            gate = [np.tanh(dot(h, [a[j] for a in p["A"]])) / (1 + np.exp(-dot(h, [b[j] for b in p["B"]]))) for j in range(n)]
            hidden.append(h)
            logit.append(dot(gate, p["w"]))
        weights = [np.exp(e - max(logit)) for e in logit]
        mean = [sum(a * h[j] for a, h in zip(weights, hidden)) / sum(weights) for j in range(n)]
        assert got[row["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(dot(mean, p["c"]) + p["b"]))), abs=1e-5)


def test_a_text_is_encoded_alike_in_any_company():
    texts = ["one two", "  two  \t three. three", "three", "x" * 50 + " y", "tail\n\n", "\n lead"]
    together, bag = q.encode_texts(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(together[bag == i], q.encode_texts([t])[0])
