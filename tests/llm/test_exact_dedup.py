import hashlib
import re

from pyspark.sql import functions as F

from thalweg.llm.exact_dedup import DigestIndex


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_largest_then_smallest_id_stays(spark, make_docs):
    got = rows(DigestIndex(spark).add(make_docs(["a b", "ab", "a  b", None, "", " \t", "x", "a b"])))
    assert [got[i]["keep_id"] for i in range(8)] == [2, 2, 2, 5, 5, 5, 6, 7]
    assert [got[i]["group_size"] for i in range(8)] == [3, 3, 3, 3, 3, 3, 1, 1]
    assert [got[i]["kept"] for i in range(8)] == [False, False, True, False, False, True, True, True]
    assert got[0]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()


def test_index_persists_between_batches(spark, make_docs):
    index = DigestIndex(spark)
    index.add(make_docs(["one", "two", "two"])).count()
    later = DigestIndex(spark, index.name)
    got = rows(later.add(make_docs(["two ", "three"]).withColumn("doc_id", F.col("doc_id") + 100)))
    assert not got[100]["kept"] and got[100]["keep_id"] == 1
    assert got[101]["kept"]
    assert later.table().count() == 3
    plan = later.table().join(later.table(), "digest")._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan


def test_empty_and_clashing_columns(spark, make_docs):
    docs = make_docs(["a", "a"]).withColumn("digest", F.lit(1)).withColumn("size", F.lit("x")).withColumn("keep_id", F.lit(None))
    assert DigestIndex(spark).add(docs).where("kept").count() == 1
    assert DigestIndex(spark).add(docs.limit(0)).count() == 0


def test_against_brute_force(spark, small_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in small_docs.collect()}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    got = rows(DigestIndex(spark).add(small_docs))
    for ids in groups.values():
        best = min(ids, key=lambda i: (-len(texts[i]), i))
        assert {got[i]["keep_id"] for i in ids} == {best}


def test_index_is_kept_compacted_and_repeatable(spark, make_docs):
    docs = make_docs(["a b", "ab", "c", None, "d" * 50])
    index = DigestIndex(spark, "kept_index", buckets=4)
    first = {r["doc_id"]: r["kept"] for r in index.add(docs, batch="monday").collect()}
    assert first == {0: True, 1: False, 2: True, 3: True, 4: True}
    assert DigestIndex(spark, "kept_index").buckets == 4
    again = DigestIndex(spark, "kept_index").add(docs).collect()
    assert not any(r["kept"] for r in again) and index.table().count() == 4
    # The batch itself, after a lost driver: the same answer, and nothing is appended.
    repeated = DigestIndex(spark, "kept_index").add(docs, batch="monday").collect()
    assert {r["doc_id"]: r["kept"] for r in repeated} == first and index.table().count() == 4
    index.add(make_docs(["e", "f g"])).count()
    before = sorted(tuple(r) for r in index.table().collect())
    index.compact(2)
    assert sorted(tuple(r) for r in index.table().collect()) == before
    assert len(index.table().inputFiles()) <= 2 and DigestIndex(spark, "kept_index").buckets == 2
    spark.sql("DROP TABLE kept_index")
