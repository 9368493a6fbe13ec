"""Readers: every one gives columns of strings first, and an explicit order where order counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.corpus import chunk_records, parse_article
from ..operators.durable import joined_to_parts, starts_of, stored
from ..operators.merge import concat_frames
from ..operators.normalize import normalize_prices, normalize_yields
from ..operators.records import split_records

YIELD_COLUMNS = ("Year", "Semester", "Region", "Province", "Municipality", "Average Yield (ton/ha)", "Date and time of Scraping")
RECORD_FIELDS = "text string, input string, content string, source string, doc_id string, url string, title string, filename string, page string"


@dataclass(frozen=True)
class CorpusSource:
    source_id: str
    path: str
    required: bool = True
    min_chars: int = 100


def read_strings(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """CSV with a header, quoted line breaks allowed, all columns as strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=False)


def read_yields(spark: SparkSession, path: str, schema_version: str = "1") -> DataFrame:
    return normalize_yields(read_strings(spark, path, YIELD_COLUMNS), schema_version)


def read_prices(spark: SparkSession, path: str, schema_version: str = "1") -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return normalize_prices(raw, schema_version)


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD_FIELDS) -> DataFrame:
    """JSON lines; blank lines, broken JSON and what is no object are skipped."""
    lines = spark.read.text(path).filter(F.ltrim("value").startswith("{"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = lines.select(F.from_json("value", schema + ", _bad string", options).alias("r"))
    return rows.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_split_jsonl(lines: DataFrame) -> DataFrame:
    """``lines(file, line_no, line)`` -> ``file, start_line, end_line, record`` of records that may span
    several physical lines (``operators.records``)."""
    return split_records(lines)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of text files, numbered from 1 in each; a file that ends with a line feed
    has an empty last line. Files are read in splits: each split's lines are counted, and its first
    number is what the counts before it leave."""
    raw = spark.read.text(path, lineSep="\n")
    at = F.monotonically_increasing_id().alias("_at")  # rises within a split
    meta = F.col("_metadata")
    rows = stored(raw.select(meta.file_path.alias("file"), meta.file_block_start.alias("_part"), meta.file_size.alias("_size"), F.col("value").alias("line"), at), "lines")
    counts = rows.groupBy("file", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.sum(F.octet_length("line") + 1).alias("_bytes"), F.first("_size").alias("_size"))
    starts = joined_to_parts(starts_of(counts, ["file"], "_n", "_before"), counts.select("file", "_part", "_first"), ["file"])
    numbered = joined_to_parts(rows.select("file", "_part", "_at", "line"), starts, ["file"])
    numbered = numbered.select("file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")
    ends = counts.groupBy("file").agg(F.sum("_n").alias("n"), F.sum("_bytes").alias("bytes"), F.first("_size").alias("size"))
    return numbered.unionByName(ends.filter("bytes = size").select("file", (F.col("n") + 1).alias("line_no"), F.lit("").alias("line")))


def read_corpora(spark: SparkSession, registry: list[CorpusSource], only: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """All registered corpora as one table with source_id, and warnings; a missing required corpus and
    an unknown id are errors, a missing optional one is a warning."""
    chosen = [s for s in registry if only is None or s.source_id == only]
    if not chosen:
        raise ValueError(f"unknown source id: {only}")
    frames, warnings = [], []
    for s in chosen:
        try:
            frames.append(read_jsonl(spark, s.path).withColumn("source_id", F.lit(s.source_id)))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            if s.required:
                raise FileNotFoundError(f"{s.source_id}: {s.path}") from e
            warnings.append(f"{s.source_id}: no file at {s.path}")
    return (concat_frames(*frames) if frames else None), warnings


def _file_name(path: Column) -> Column:
    """Last part of a path as Spark gives it, with its percent signs resolved."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def read_text_records(
    spark: SparkSession, path: str, source: str, base_id: Callable[[Column, Column], Column] | None = None, preprocess: Callable[[Column], Column] | None = None, size: int = 2000, least: int = 100
) -> DataFrame:
    """Text files, one document each -> corpus records: read, stripped, ``preprocess``ed, cut into chunks.

    ``base_id(file name, raw text)`` gives the id's stem; by default the file name without its ending and
    with everything but letters, digits, ``_-.`` as ``_``. Blank files give nothing."""
    raw = spark.read.text(path, wholetext=True).select(_file_name(F.col("_metadata.file_path")).alias("filename"), strip(F.col("value")).alias("raw")).filter("raw != ''")
    stem = F.substring(F.regexp_replace(F.regexp_replace("filename", r"\.[^.]+$", ""), r"(?U)[^\w\-.]", "_"), 1, 120)
    rows = raw.select("filename", (base_id(F.col("filename"), F.col("raw")) if base_id else stem).alias("base"), (preprocess(F.col("raw")) if preprocess else F.col("raw")).alias("text"))
    cut = chunk_records(rows, F.col("base"), size, least)
    return cut.select(F.col("chunk_text").alias("text"), F.col("chunk_text").alias("input"), F.lit(source).alias("source"), F.col("chunk_doc_id").alias("doc_id"), "filename")


def read_sheets(spark: SparkSession, path: str, width: int = 512) -> DataFrame:
    """A folder of sheets saved as CSV, one a file -> ``file, sheet, row_idx, cells``: the file's name up to its
    last dot is the file, and what follows ``__`` in it, if anything, the sheet. Empty cells are null, and
    rows are as long as their last filled cell. Cells hold no line breaks."""
    lines = read_lines(spark, path).withColumn("line", F.rtrim("line", F.lit("\r")))
    name = F.regexp_replace(_file_name(F.col("file")), r"\.[^.]*$", "")
    fields = [f"c{i}" for i in range(width)]
    row = F.from_csv("line", ", ".join(f"{c} string" for c in fields), {"escape": '"'})
    parsed = lines.withColumns({"_r": row, "_name": name})
    cells = F.array(*(F.nullif(F.col(f"_r.{c}"), F.lit("")) for c in fields))
    last = F.array_max(F.transform(cells, lambda x, i: F.when(x.isNotNull(), i + 1)))
    parts = F.split("_name", "__", 2)
    return parsed.select(parts[0].alias("file"), F.coalesce(F.get(parts, F.lit(1)), F.lit("Sheet1")).alias("sheet"), F.col("line_no").alias("row_idx"), F.slice(cells, 1, F.coalesce(last, F.lit(0))).alias("cells"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article files -> file, url, title, body."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("filename"), parse_article(F.col("value")).alias("a"))
    return raw.select("filename", "a.*")


def read_snapshot(spark: SparkSession, path: str, tier: str = "latest", snapshot_date: str | None = None) -> DataFrame:
    """A dated snapshot: the ``latest``, the one before it (``backup``), or that of a date."""
    every = spark.read.parquet(path)
    if snapshot_date is None:
        dates = every.select(F.col("snapshot_date").cast("string")).distinct().orderBy(F.desc("snapshot_date")).limit(2).collect()  # two values
        at = {"latest": 0, "backup": 1}[tier]
        if len(dates) <= at:
            raise FileNotFoundError(f"no {tier} snapshot in {path}")
        snapshot_date = dates[at][0]
    return every.filter(F.col("snapshot_date").cast("string") == snapshot_date).drop("snapshot_date")
