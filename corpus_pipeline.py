"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.neardup import ROW_KEY, kept_rows, with_row_key
from fieldloom.llm.packing import pack_documents
from fieldloom.llm.quality import with_quality
from fieldloom.llm.repeats import without_repeats
from fieldloom.llm.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source stay."""
    return with_quality(docs).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, one row stays: the one with the smallest id
    (null ids last, then by text hash), and one of rows with equal id and text."""
    # Partial aggregates first, so that no task holds all rows of a text that is repeated often.
    once = with_row_key(docs).groupBy(*ROW_KEY).agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("_r"))
    # Never broadcast: the list grows with the input.
    kept = kept_rows(docs, ngram=5, percent=80).hint("merge")
    return once.join(kept, list(ROW_KEY), "left_semi").select("_r.*").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand elsewhere too are cut; emptied documents go.

    Repeats are found from 240 bytes on, and where 51 words take less, by the words themselves; those of
    50 words or fewer stay. Null texts go as empty ones do; of rows with equal
    texts, which the stage before leaves out, both would go; an empty table stays empty.
    """
    cut = without_repeats(docs, length=240, least_words=51)
    return cut.withColumn("n_chars", F.length("text").cast("long")).filter(F.coalesce(F.trim("text"), F.lit("")) != "").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and token-budget batches."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

ORACLE_SQL = None  # no stage can be written in SQL; tests/llm holds the run against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
