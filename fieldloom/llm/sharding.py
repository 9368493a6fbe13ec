"""Sharding by proportional stratified interleaving: every shard gets the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, with_rank


def interleave(docs: DataFrame, shards: int = 24, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot``, one row per row of ``docs``.

    The rows of each source, shuffled by a seeded hash, get the fractional ranks (r + 1/2) / n. Sorted
    by these, every stretch of rows holds each source in its share, to within one row; the sorted rows
    are cut into ``shards`` stretches, so the rows of the shards differ by at most one, and each
    shard's rows of a source by at most two from its share. The order inside a shard is the slot.

    Both ranks come from range partitions with counts (``with_rank``); only ids, sizes and checksums
    are shuffled, never texts. A null source is a source. Null text: size 8, checksum of nothing (0).
    Repeated rows get places of their own; which of two equal rows gets which does not show. Fewer
    rows than shards leave the last shards empty; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.unhex(F.lit("")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    draw = F.xxhash64(F.lit(seed), "doc_id", "text_crc32")
    ranked = materialize(with_rank(rows, ["source"], [draw, F.col("doc_id"), F.col("text_crc32")], "_rank"), "strata")
    counts = ranked.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_source")
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = ranked.withColumn("_share", (2 * F.col("_rank") + 1) / (2 * F.col("_n"))).drop("_rank", "_n")
    order = [F.col("_share"), F.xxhash64(F.lit(seed), "source"), draw, F.col("doc_id"), F.col("text_crc32")]
    placed = with_rank(ranked, [], order, "_place").drop("_share")
    total = docs.count()
    shard = F.expr(f"cast(_place * {shards} div {max(1, total)} as int)")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_place") - first).drop("_place")
