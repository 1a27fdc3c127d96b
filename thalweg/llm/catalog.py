"""Registry of this subpackage's queries and oracles."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline

from . import decontamination, exact_dedup, hard_negatives, language_id, licences, line_dedup, packing, quality, repeated_passages, repeated_phrases, simhash, token_alignment, url_filter
from .common import table


def op1_suffix_array_dedup(spark, sf_dir):
    return repeated_passages.remove(table(spark, sf_dir, "documents")).drop("spans")


def op2_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.DigestIndex(spark).add(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.near_duplicate_lines(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_license_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"), windows=True).select("doc_id", "license", "dice", "n_matches")


def op10_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(hard_negatives.with_planted_labels(table(spark, sf_dir, "embeddings"), "vec_id", "label"))


def op13_substring_dedup(spark, sf_dir):
    return repeated_phrases.remove(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_url_filters": op2_url_filters,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_quality": op5_quality,
        "op6_language_id": op6_language_id,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op9_license_scan": op9_license_scan,
        "op10_simhash_dedup": op10_simhash_dedup,
        "op11_token_alignment": op11_token_alignment,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_substring_dedup": op13_substring_dedup,
        "pipeline": pipeline,
    }


def oracle_sql():
    found = {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL, "op13_substring_dedup": repeated_phrases.ORACLE_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
