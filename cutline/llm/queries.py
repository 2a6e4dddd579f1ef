"""The corpus operators bound to the tables: ``opN_<name>`` queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, chunk_dedup, decontaminate, language, licenses, lm_scoring, packing, quality, simhash, suffix_dedup, token_counts, token_files, vector_codes
from .common import read_table, shared_path

QUALITY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


REPEAT_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
DECONTAMINATION_COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.license_scan(docs, licenses.registry(spark)).drop("text")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, with_text=False).select(*REPEAT_COLUMNS)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.remove_repeated_chunks(docs, with_text=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_columns(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(*QUALITY_COLUMNS)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", *DECONTAMINATION_COLUMNS)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_digests(token_files.read_token_files(spark, path))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return alignment.align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    every = (
        op1_license_scans,
        op2_suffix_array_dedup,
        op3_substring_dedup,
        op4_benchmark_decontamination,
        op5_language_id,
        op6_quality_rules,
        op7_best_fit_packing,
        op8_lm_scoring,
        op9_simhash_near_dedup,
        op10_token_files,
        op11_vector_codes,
        op12_token_counts,
        op13_tokenizer_alignment,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict:
    return {"op1_license_scans": licenses.ORACLE_SQL, "op6_quality_rules": quality.ORACLE_SQL, "op11_vector_codes": vector_codes.ORACLE_SQL}
