import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import decontamination as dc


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def edits(item, text):
    """Smallest edit distance of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_stretch_against_plain_programme():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, text = rng.integers(0, 5, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64)
        d, s, e = dc.best_stretch(item, text, 99)
        assert d == edits(item.tolist(), text.tolist())
        assert edits(item.tolist(), text[s:e].tolist()) == d


def test_word_hashes():
    assert len(dc.words(None)) == len(dc.words(" \n")) == 0
    a = dc.words("The cat\tsat on THE mat Éa éa")
    assert a[0] == a[4] and len(set(a.tolist())) == 7


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(2, 8))) for _ in range(3000)] + ["the", "of", "and"] * 300
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(rng.randrange(14, 60)) for i in range(40)} | {40: text(6), 41: text(3), 42: []}
    docs, truth = {}, {}
    for d in range(400):
        words = text(rng.randrange(30, 300))
        docs[d], truth[d] = words, None
        if d % 2:
            n = rng.randrange(40)
            copy = list(items[n])
            for _ in range(rng.randrange(0, int(len(copy) * 0.15) + 1)):
                at = rng.randrange(len(copy))
                kind = rng.randrange(3)
                copy[at : at + (kind != 1)] = [] if kind == 0 else ["edited"]
            at = rng.randrange(len(words))
            docs[d], truth[d] = words[:at] + copy + words[at:], n
    docs[400], truth[400] = text(20) + items[40] + text(20), 40
    docs[401], truth[401] = text(20) + items[41] + text(20), 41
    return {i: " ".join(w) for i, w in items.items()}, {d: " ".join(w) for d, w in docs.items()}, truth


def test_planted_items_are_found_and_clean_texts_left(spark, planted):
    items, docs, truth = planted
    b = spark.createDataFrame([*items.items(), (99, None)], "item_id long, text string")
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in dc.find(d, b).collect()}
    assert len(got) == len(docs)
    near = {i for i, n in truth.items() if n is not None and edits(split(items[n]), split(docs[i])) <= dc.allowed(len(split(items[n])))}
    caught = {i for i in near if truth[i] in [h["item_id"] for h in got[i]["hits"]]}
    assert len(caught) >= 0.97 * len(near)
    assert {400, 401} <= caught
    for i, r in got.items():
        for h in r["hits"]:
            words = split(docs[i])[h["first_word"] : h["end_word"]]
            assert edits(split(items[h["item_id"]]), words) == h["edits"] <= dc.allowed(len(split(items[h["item_id"]])))
    kept = {r["doc_id"] for r in dc.drop_contaminated(d, b).collect()}
    assert kept == {i for i, r in got.items() if not r["contaminated"]}
    assert all(i in kept for i, n in truth.items() if n is None)


def test_exact_copies_of_the_small_tables(spark):
    at = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in dc.find(docs, bench).collect()}
    items = bench.collect()
    for r in docs.collect():
        assert {i["item_id"] for i in items if i["text"] in r["text"]} <= got[r["doc_id"]]


def test_hard_cases(spark, make_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, ""), (3, None)], "item_id long, text string")
    long = "filler words " * 120_000 + "one two three four five six " + "more words " * 1000
    docs = make_docs([None, "", long, "seven eight nine ten eleven twelve", "ONE two\nthree  four five six"]).withColumn("hits", F.lit(1)).withColumn("item_id", F.lit("x"))
    got = {r["doc_id"]: r["n_items"] for r in dc.find(docs, bench).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    monkeypatch.setattr(dc, "ITEM_BLOCK", 1)
    assert {r["doc_id"]: r["n_items"] for r in dc.find(docs, bench).collect()} == got
    assert dc.find(docs.limit(0), bench).count() == 0
    assert dc.find(docs, bench.limit(0)).where("contaminated").count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == 5
    assert dc.drop_contaminated(docs, bench).columns == docs.columns


def found_in(docs, items):
    df = lambda spark, rows, names: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], names)
    return lambda spark: {r["doc_id"]: {h["item_id"]: h["edits"] for h in r["hits"] or []} for r in dc.find(df(spark, docs, "doc_id long, text string"), df(spark, items, "item_id long, text string")).collect()}


def test_short_items_are_found_at_every_word(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 10)}
    docs = {10 * n + r: ["filler"] * (20 + r) + items[n] + ["after"] * 9 for n in items for r in range(4)}
    assert found_in(docs, items)(spark) == {d: {d // 10: 0} for d in docs}


def test_every_item_within_the_edits_is_found(spark):
    """Recall by length (5 to 120 words) at the largest number of edits, anywhere in the item, is whole."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)] + ["the", "of"] * 200
    items, docs = {}, {}
    for length in (5, 6, 7, 8, 9, 10, 14, 20, 40, 60, 120):
        for _ in range(20):
            n = len(items)
            items[n] = [rng.choice(vocabulary) for _ in range(length)]
            copy = list(items[n])
            for at in sorted(rng.sample(range(length), dc.allowed(length)), reverse=True):
                kind = rng.randrange(3)
                copy[at : at + (kind != 1)] = [] if kind == 0 else ["edited"]
            docs[n] = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 60))] + copy + [rng.choice(vocabulary) for _ in range(30)]
    got = found_in(docs, items)(spark)
    missed = [len(items[n]) for n in items if n not in got[n]]
    assert not missed, {x: missed.count(x) for x in sorted(set(missed))}
    assert all(got[n][n] == edits(items[n], docs[n]) for n in items)


def test_blocks_of_items_give_the_same_hits(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    key = lambda df: sorted((r["doc_id"], sorted(tuple(h) for h in r["hits"] or [])) for r in df.collect())
    whole, kept = key(dc.find(docs, items)), sorted(r["doc_id"] for r in dc.drop_contaminated(docs, items).collect())
    monkeypatch.setattr(dc, "ITEM_BLOCK", 20)
    assert key(dc.find(docs, items)) == whole
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(docs, items).collect()) == kept
