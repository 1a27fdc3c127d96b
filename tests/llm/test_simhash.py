import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from thalweg.llm import simhash
from thalweg.llm.common import components


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprint_matches_definition():
    for t in [None, "", " \n", "a", "A b", "a b c d", "The cat sat on\tthe mat Été and ran", "x " * 50, "É É b c d e"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_documents_against_brute_force(spark, small_docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(small_docs).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in small_docs.collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


def test_links_of_dense_groups_and_blocks(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = set()
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = {i: x for i, x in enumerate(sorted(fps))}
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps.values()]
    where = {s[0]: i for i, s in enumerate(signed)}
    for block in (8, 16384):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), block=block).collect()
        root = {i: i for i in fps}
        named = spark.createDataFrame([(where[e["a"]], where[e["b"]]) for e in edges], "a long, b long")
        root.update({r["node"]: r["root"] for r in components(named).collect()})
        assert root == brute_components(fps)


def test_hard_cases(spark, make_docs):
    docs = make_docs([None, "", "\t", "one two", "one  TWO", "lone"]).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(None))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i]["component_id"] for i in range(6)][:5] == [0, 0, 0, 3, 3]
    assert got[0]["fingerprint"] == "0" * 16
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 3, 5}


def test_components_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(5, 50))
    assert 3 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_ids_are_judged_by_their_texts(spark):
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i * 7 % 61}" for i in range(60))
    rows = [(5, long), (5, other), (7, other), (9, long), (9, long), (None, "alone here"), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__keep", F.lit(1)).withColumn("fp", F.lit(2))
    got = simhash.near_duplicates(docs).collect()
    group = {}
    for r in got:
        group.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(g) == 1 for g in group.values()) and len(group) == 4
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, long), (5, other), (None, "alone here"), (11, None)], key=str)
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
