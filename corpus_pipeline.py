"""The corpus pipeline: documents to packed training sequences, one operator a stage.

Defined results of every stage: a null text counts as an empty one, which the first
stage rejects; null ids, languages and sources pass through as they are; repeated
rows are rows each, until near-dedup keeps one of them; very long texts are taken
whole; further columns, whatever their names, stay untouched in all stages but the
last, which gives pieces; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import decontaminate, near_copies, packing, quality, suffix_dedup
from cutline.llm.common import keep, read_table

#: Bytes of a repeat in the suffix-array stage: passages of over 50 words reach it (words take 6.3 bytes on average, so 50 take about 317).
REPEAT = 256
#: Units that a packing task remembers a generation; workers go from stage to stage, and what they hold adds up beside the others' work.
UNITS = 100_000


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with ``clean_text`` as text and its length beside it."""
    own = {"text": F.col("clean_text").alias("text"), "n_chars": F.length("clean_text").cast("long").alias("n_chars")}
    return df.select(*[own.get(c, F.col(c)) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines removed; equal rows get one verdict each, and it is the same."""
    return _with_text(quality.passing(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the least id.

    Ties of ids go to the least hash of the text, a null id only stays where its
    group has no other, and of equal rows one stays.
    """
    return near_copies.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its bytes that strings of ``REPEAT`` bytes repeat; both places of a repeat lose them, and a text may become empty."""
    return _with_text(suffix_dedup.remove_repeats(docs, length=REPEAT), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; what the others hold of the benchmark below the limit is cut out.

    Items without words, or with a null text, match nothing; an empty benchmark keeps every document as it is.
    """
    judged = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _with_text(judged.where("NOT contaminated"), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their place in the packed sequences; an empty text is a piece of its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), units=UNITS)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The byte-level and hashing stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
