"""Cutting the plan of an iterative job with a table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """As the session names it; only a local session gets a folder of its own where none is named."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-"))
        found = context.getCheckpointDir()
    return found


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` written and read back: the next round starts from files, which outlive any executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_merged(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, but not broadcast: numbers take a byte or so in a file, by which Spark sizes them, and a hundred times that as a hash table."""
    return cut(df, name).hint("merge")
