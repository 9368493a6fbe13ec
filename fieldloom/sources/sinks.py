"""Writers: JSON lines, CSV, keyed tables, dated snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import chunk_records
from ..operators.merge import upsert
from ..operators.normalize import corpus_payload
from ..functions.text import sanitize


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line per record; unset keys are left out."""
    rows.write.mode(mode).json(path, ignoreNullFields=True)


def compacted(records: DataFrame, clean: bool = True) -> DataFrame:
    """Records (a JSON ``record`` each) with text, input and content the same, cleaned text."""
    v = F.from_json("record", "map<string,string>")
    text = F.coalesce(v["text"], v["input"], v["content"])
    text = sanitize(text) if clean else text
    return records.select(
        text.alias("text"), text.alias("input"), text.alias("content"),
        *(v[k].alias(k) for k in ("source", "doc_id", "url", "title", "filename")), v["page"].try_cast("int").alias("page"),
    )


def export_rows(rows: DataFrame, columns: list[str], cap: int | None = None, key: str = "point_id") -> DataFrame:
    """Chosen columns as strings, missing ones empty; ``cap``: the first rows by key."""
    rows = rows if cap is None else rows.orderBy(key).limit(cap)
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))


def write_csv(rows: DataFrame, path: str, columns: list[str], cap: int | None = None) -> None:
    export_rows(rows, columns, cap).write.csv(path, header=True, escape='"')


def write_store(spark: SparkSession, new: DataFrame, store: str, version: int, key: str = "point_id", seq: str | None = None, fresh: bool = False) -> str:
    """Upserts into the keyed table ``store/v{version - 1}`` and writes the result as the next version;
    the version being read is never overwritten, and a repeated call gives the same table."""
    path = f"{store}/v{version}"
    if version > 1 and not fresh:
        merged = upsert(spark.read.parquet(f"{store}/v{version - 1}"), new, key, seq)
    else:
        merged = upsert(new.limit(0), new, key, seq)
    merged.write.mode("overwrite").parquet(path)
    return path


def index_rows(rows: DataFrame, passage: Column, seq: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised rows with point_id -> records and passages to store (the last row of each id), and one
    row of counts: rows seen, records, passages."""
    records = upsert(rows.limit(0), rows, "point_id", seq)
    knowledge = records.withColumn("text", passage)
    seen = rows.agg(F.count("*").alias("rows_seen"))
    stored = records.agg(F.count("*").alias("records"), F.count("*").alias("knowledge"))
    return records, knowledge, seen.join(stored)  # one row each


def index_corpora(records: DataFrame, size: int = 0) -> tuple[DataFrame, DataFrame]:
    """Records with source_id -> payloads to store, and per source the rows read, indexed and skipped."""
    rows = chunk_records(records, F.col("doc_id"), size, 1).withColumn("text", F.col("chunk_text")).withColumn("doc_id", F.col("chunk_doc_id")) if size else records
    payloads = corpus_payload(rows, F.col("source_id"))
    read = rows.groupBy("source_id").agg(F.count("*").alias("read"))
    kept = payloads.groupBy("source_id").agg(F.count("*").alias("indexed"))
    stats = read.join(kept, "source_id", "left").na.fill(0)
    return payloads, stats.withColumn("skipped", F.col("read") - F.col("indexed"))


def write_snapshot(rows: DataFrame, path: str, snapshot_date: str) -> None:
    """Adds (or replaces) the partition of a date."""
    dated = rows.withColumn("snapshot_date", F.lit(snapshot_date))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)
