"""Corpus pipeline: documents to packed training sequences, one operator of ``thalweg.llm`` in each stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Equal rows get equal treatment unless a stage says otherwise, and an empty table stays
empty. ``run`` writes each stage's result to the shared folder and rereads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from thalweg.llm import decontamination, language_id, line_dedup, packing, simhash
from thalweg.llm.common import settle, table

TOKENIZER = "word_bpe_49k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected go: null and empty texts, and those without a letter, too."""
    return language_id.drop_rejected(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with one line of each group of near-equal lines in the corpus; texts may end up empty, null ones stay null."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; empty texts are one group, of repeated rows one stays."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark keeps all."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; null and empty texts are a piece of one token."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn, hash and pack in ways that SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
