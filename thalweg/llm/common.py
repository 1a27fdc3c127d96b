"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a local session gets one of its own; on a cluster that is an error, since
    executors elsewhere could not reach it.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-"))
        found = context.getCheckpointDir()
    return found


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors and leaves Spark a file size to plan with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_at = path
    return found


def forget(*settled: DataFrame) -> None:
    """Delete the folders of settled steps that nothing reads any more."""
    for df in settled:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect what finished steps left behind.

    Spark removes shuffle files, broadcasts and compiled plans only after the driver's collector has
    found them unused; over many short jobs that is too late for its memory and the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (long columns ``a`` and ``b``), by alternating
    large-star and small-star steps; returns ``node`` and ``root``, the smallest node of its component.

    Every step joins nothing: neighbours meet their smallest neighbour through a partial ``min``
    aggregate and a join of edges with it, so a node with many links is split like any skewed join.
    The loop ends when a step changes no edge; it takes about log2 of the widest component rounds.
    Rows with a null end, and self-links, are ignored. No edges: no rows.
    """
    pairs = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    pairs = settle(pairs, "edges")
    before = _digest(pairs)
    for _ in range(limit):
        if before[0] == 0:
            break
        # Large star: every larger neighbour of a node is linked to the node's smallest one.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        last, pairs = pairs, settle(small, "edges")
        forget(last)
        after = _digest(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
    found.settled_at = pairs.settled_at
    tidy(edges.sparkSession)
    return found


def _digest(pairs: DataFrame) -> tuple:
    """Count and order-free checksum of a set of edges."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
