"""Exact deduplication through a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one keeper for each
digest, the keepers are anti-joined with the index (a sort-merge join whose index side needs no
exchange; Spark's sort of it meets buckets that are in order) and those that are new are appended
under the batch's name. Only built-in functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

BUCKETS = 64


def normalised(text: str = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``digest`` (SHA-256 of the normalised text) and ``size`` (code points of the original)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(normalised(text), 256).alias("digest"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"),
    )


class DigestIndex:
    """``name`` is a table of (digest, keep_id, batch), bucketed and sorted by digest.

    Defined cases: null text counts as empty, so all empty texts are one group; the row with most
    code points stays, ties go to the smallest id; a row whose id and text repeat another's counts
    in ``group_size`` and gets the same answer; an empty batch appends nothing; further columns of
    the batch are never read, whatever they are called.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if spark.catalog.tableExists(self.name):
            # The table keeps the number of buckets that it was made with.
            told = spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(told["data_type"])
        else:
            self._write(spark.createDataFrame([], "digest string, keep_id long, batch string"), "errorifexists")

    def _write(self, df: DataFrame, mode: str, name: str | None = None) -> None:
        # Dealt as the buckets are: one file for each bucket, whatever the number of tasks before.
        dealt = df.repartition(self.buckets, "digest")
        dealt.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name or self.name)

    def compact(self, buckets: int | None = None) -> None:
        """One file for each bucket again, in another number of buckets if asked for.

        The new table is whole before the old one goes; where the driver is lost between the two, it
        is found under the old name with ``_compacted`` behind it.
        """
        self.buckets = buckets or self.buckets
        fresh = f"{self.name}_compacted"
        self._write(self.table(), "overwrite", fresh)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate a batch against itself and the index, and append what is new.

        Returns doc_id, keep_id, group_size (rows of this batch with that text), kept, text_sha256.
        ``kept`` is false for every row whose text an earlier batch brought; ``keep_id`` is then the
        row that stayed at that time. A batch of a name that is added again, as after a lost driver,
        finds its own rows in the index: nothing is appended twice, and the answer is the same.
        Without a name every call is a batch of its own.
        """
        batch = batch or uuid.uuid4().hex
        rows = settle(digests(docs, id_col, text), "digests")
        groups = settle(
            rows.groupBy("digest").agg(
                F.max_by("doc_id", F.struct("size", -F.col("doc_id"))).alias("best"),
                F.count("*").alias("group_size"),
            ),
            "groups",
        )
        new = groups.hint("merge").join(self.table().hint("merge"), "digest", "left_anti")
        known = groups.hint("merge").join(self.table().hint("merge"), "digest").select("digest", "group_size", "keep_id", (F.col("batch") == batch).alias("fresh"), F.lit(True).alias("stored"))
        decided = settle(
            new.select("digest", "group_size", F.col("best").alias("keep_id"), F.lit(True).alias("fresh"), F.lit(False).alias("stored")).unionByName(known),
            "decided",
        )
        self._write(decided.where("not stored").select("digest", "keep_id", F.lit(batch).alias("batch")), "append")
        return rows.join(decided, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS size FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
         CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
