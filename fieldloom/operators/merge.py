"""Keyed merges: upserts, keep-first and keep-last, replacement by source, work left to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import sized, stored, with_rank, with_running_sum

PRICE_KEY = ["Geolocation", "Commodity", "Year", "Month"]


def keep_last(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each key that comes last in order: an aggregate with partial results, no window. Rows with
    strings are kept in a sort aggregate, one row a key in each task before the shuffle."""
    by = F.struct(*(F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)))
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*(f"`{k}`" for k in keys)).agg(F.max_by(F.struct(*(f"`{c}`" for c in rest)), by).alias("_r"))
    return picked.select(*(f"`{k}`" for k in keys), "_r.*").select(*(f"`{c}`" for c in rows.columns))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    by = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def keep_first_by_url(rows: DataFrame, order: str, url: str = "url") -> DataFrame:
    """First row of each URL; rows with a blank URL all stay, and are set aside first, for they would
    all be one key."""
    blank = F.coalesce(F.trim(url), F.lit("")) == ""
    return rows.filter(blank).unionByName(keep_first(rows.filter(~blank), [url], [order]))


def upsert(existing: DataFrame, new: DataFrame, key: str = "point_id", seq: str | None = None) -> DataFrame:
    """Rows of both by key, the new one counting, and of new ones the last in ``seq``. Idempotent."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = ["_new"] + ([seq] if seq else [F.xxhash64(*(f"`{c}`" for c in new.columns))])
    return keep_last(both, [key], order).drop("_new")


def merge_prices(existing: DataFrame | None, new: DataFrame | None, updated_urls: DataFrame | None, resume: bool, seq: str = "seq") -> DataFrame | None:
    """Price table after a run. A full run keeps the new rows only. A resumed run keeps the existing rows
    whose Source URL was not updated, then the new ones; without that column or URLs, all of both.
    Of equal (place, commodity, year, month) the last stays, new rows after existing ones. Nothing to
    write gives None."""
    if not resume or existing is None:
        return None if new is None else keep_last(new, PRICE_KEY, [seq])
    if updated_urls is not None and "Source URL" in existing.columns:
        gone = updated_urls.select(F.col(updated_urls.columns[0]).alias("_url")).distinct()
        gone = sized(stored(gone, "updated"))  # few URLs, each of very many rows, which must not meet in one task
        existing = existing.join(gone, F.col("`Source URL`") == F.col("_url"), "left_anti")
    both = existing.withColumn("_new", F.lit(0))
    if new is not None:
        both = both.unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, PRICE_KEY, ["_new", seq]).drop("_new")


def concat_frames(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def work_grid(*dims: DataFrame) -> DataFrame:
    """All combinations of small dimension tables (years, semesters, provinces of regions)."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims)


def pending(work: DataFrame, done: DataFrame, *more: DataFrame, on: str = "key") -> DataFrame:
    """Work whose key is in none of the done tables."""
    return reduce(lambda w, d: w.join(d.select(on).distinct(), on, "left_anti"), (done, *more), work)


def leftovers(files: DataFrame, url_to_file: DataFrame, url_to_title: DataFrame) -> DataFrame:
    """Files with the URL they came from, and its title."""
    return files.join(url_to_file.select("filename", "url"), "filename", "left").join(url_to_title.select("url", "title"), "url", "left")


def repaired_checkpoint(url_to_file: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries of a checkpoint whose file exists."""
    return url_to_file.join(listing.select("filename").distinct(), "filename", "left_semi")


def urls_by_position(urls: DataFrame, indices: DataFrame) -> DataFrame:
    """``urls(urls array)`` and ``indices(position)`` -> the URLs at these positions; others are dropped."""
    return urls.select(F.posexplode("urls").alias("position", "url")).join(indices, "position").select("url")


def unique_names(rows: DataFrame, base: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """``unique_name``: rows of a base name in order get it, then base_2, base_3, ...: the first that no
    ``existing`` name (a column called like the base) has. A base that looks like another one's name
    (x_2 beside x) keeps its own.

    The k-th free number of a base is k and as many more as taken numbers come before it; a taken number t
    comes before it if fewer than k numbers below t are free. Both are ranks over range partitions, so
    no task holds all rows of a base.
    """
    name = F.col(f"`{base}`")
    named = rows.select(name.alias("_name"))
    if existing is not None:
        named = named.unionByName(existing.select(name.alias("_name")))
    number = F.regexp_extract("_name", r"_([1-9]\d{0,17})$", 1).try_cast("long")
    whole = named.distinct()
    taken = whole.filter(number > 1).select(F.regexp_replace("_name", r"_\d+$", "").alias("_base"), number.alias("_t"))
    if existing is not None:
        taken = taken.unionByName(existing.select(name.alias("_base"), F.lit(1).cast("long").alias("_t")).distinct())
    taken = with_rank(taken.join(rows.select(name.alias("_base")).distinct(), "_base", "left_semi"), ["_base"], ["_t"], "_i")
    ranked = stored(with_rank(rows, [base], [order], "_k").withColumn("_row", F.monotonically_increasing_id()), "names")
    # Of equal keys the rows come first: only taken numbers with fewer than k free ones below count.
    events = ranked.select(name.alias("_base"), (F.col("_k") + 1).alias("_at_key"), F.lit(0).alias("_taken"), "_row")
    events = events.unionByName(taken.select("_base", (F.col("_t") - F.col("_i") - 1).alias("_at_key"), F.lit(1).alias("_taken"), F.lit(None).cast("long").alias("_row")))
    counted = with_running_sum(events, ["_base"], ["_at_key", "_taken", "_row"], "_taken", "_before").filter("_taken = 0").select("_row", "_before")
    n = F.col("_k") + 1 + F.col("_before")
    out = ranked.join(counted, "_row").withColumn("unique_name", F.when(n == 1, name).otherwise(F.concat_ws("_", name, n.cast("string"))))
    return out.drop("_k", "_row", "_before")


def snapshots_to_drop(snapshots: DataFrame, keep: int = 2) -> DataFrame:
    """``snapshots(file, snapshot_date)`` beyond the newest ``keep`` of each file."""
    newest = Window.partitionBy("file").orderBy(F.desc("snapshot_date"))
    return snapshots.withColumn("age", F.row_number().over(newest)).filter(F.col("age") > keep)


def crawl_status(ledger: DataFrame) -> DataFrame:
    """Counts of a ledger of URLs with boolean columns listed, verified, dead, fetched, skipped."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = ledger.agg(*(n(c).alias(c) for c in ("listed", "verified", "dead", "fetched", "skipped")))
    return out.withColumn("incomplete", F.col("verified") + F.col("dead") < F.col("listed"))


def trim_history(messages: DataFrame, limit: int = 10, size: int = 4000) -> DataFrame:
    """Last ``limit`` user and assistant messages of each conversation, stripped, blank ones left out."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    valid = messages.filter(F.col("role").isin("user", "assistant")).withColumn("text", F.substring(text, 1, size)).filter("text != ''")
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text")
    return valid.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= limit).drop("_n")


def running_index(rows: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Gapless 0-based index over all rows in order, without one task holding them: rows are sorted by
    range and stored, and each partition starts where the counts of those before it end. All columns are
    stored, so leave out beforehand what is not wanted."""
    return with_rank(rows, [], order, name)
