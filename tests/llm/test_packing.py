import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thalweg.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "Hello, WORLD's 123 you'll", "<|endoftext|> x", "ΣΑΣ Σ", "é é İ ı", "x\x1cy\x85z\xa0w", "½²a_b__c --- ''s",
    "日本語 text", "ﬁ ǅ ǆ ß ẞ", "word " * 9000, "​ zero", "don't can't I'm 'S 'T",
]


TOKENIZER = Tokenizer.from_file(PATH)


def expected(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    tokenizer = Tokenizer.from_file(PATH)
    for i, t in texts.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(ids) // capacity)))
        for r in got:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and r["length"] == min(capacity, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_words_agree_with_the_tokenizer():
    words = packing.Words(PATH)
    for t in [*ODD, "a\x00b", *(chr(c) + "x " + chr(c) for c in range(0x300))]:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == expected(t)[:-1], repr(t)


def test_documents_round_trip_and_near_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    used = check(rows, texts, packing.CAPACITY)
    assert used <= 1.01 * -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1


def test_hard_cases(spark, make_docs):
    docs = make_docs(ODD).withColumn("length", F.lit("x")).withColumn("uid", F.lit(0)).withColumn("bin", F.lit(1))
    check(packing.pack_documents(docs, PATH, capacity=64, shard=5).collect(), dict(enumerate(ODD)), 64)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    twice = packing.pack_documents(docs.limit(4).union(docs.limit(4)), PATH)
    assert twice.count() == 8


@pytest.mark.parametrize("seed", [1, 2])
def test_crossover_keeps_every_item(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 90, 300)
    parents = []
    for _ in range(2):
        p = packing.Bins(sizes, 100)
        p.place(rng.permutation(300)[:150].tolist())
        p.place([i for i in range(300) if i not in {x for b in p.bins for x in b}])
        parents.append(p)
    child = packing.cross(*parents, rng)
    assert sorted(x for b in child.bins for x in b) == list(range(300))
    assert all(f == sizes[b].sum() <= 100 for f, b in zip(child.fill, child.bins))


def test_crossover_beats_best_fit():
    """Triplets that fill bins to the brim: best fit decreasing needs more bins than the crossovers find."""
    rng = np.random.default_rng(5)
    sizes = []
    for _ in range(60):
        a = int(rng.integers(380, 490))
        b = int(rng.integers((1000 - a) // 2 - 50, (1000 - a) // 2 + 50))
        sizes += [a, b, 1000 - a - b]
    sizes = np.array(sizes)
    greedy = packing.Bins(sizes, 1000)
    greedy.place(list(range(len(sizes))))
    first, none = packing.evolve(sizes, [], 1000, 3, 6, 0)
    best, accepted = packing.evolve(sizes, [], 1000, 3, 6, 200)
    assert none == 0 and accepted > 10
    assert 60 <= len(best.bins) < len(greedy.bins) and len(best.bins) < len(first.bins)


def test_crossovers_run_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = packing.pieces(docs, PATH).where(F.col("length") < packing.CAPACITY).select("uid", "length")
    rows = packing.pack(items, epochs=1).select("accepted").distinct().collect()
    assert all(r["accepted"] > 0 for r in rows)


def test_another_file_is_left_to_the_tokenizer(tmp_path):
    text = open(PATH, encoding="utf-8").read().replace('"Lowercase"', '"NFC"', 1)
    other = tmp_path / "other.json"
    other.write_text(text, encoding="utf-8")
    words = packing.Words(str(other))
    assert not words.plain
    assert np.frombuffer(words.ids("Hello World"), "<u4").tolist() == Tokenizer.from_file(str(other)).encode("Hello World", add_special_tokens=False).ids
