"""Tables written to the folder that driver and executors share, and ranks and running sums over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only on one machine, where it is unset, a temporary
    folder is set instead; on a cluster that is an error, as executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: the lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_range(rows: DataFrame, group: list[str], order: list[Column | str], name: str = "ranges") -> DataFrame:
    """The rows sorted by group and order over range partitions, stored with ``_at`` (their place, rising
    over all rows) and ``_part`` (their partition), so that later passes see one and the same dealing. The rows
    are stored unsorted first, as the ranges' bounds take a pass of their own, which would make them again."""
    made = stored(rows, f"{name}-rows")
    out = ranged(made, group, order, name)
    discard(made)
    return out


def ranged(made: DataFrame, group: list[str], order: list[Column | str], name: str = "ranges") -> DataFrame:
    """``by_range`` of rows that are stored already."""
    keys = [F.col(f"`{c}`") for c in group]
    rows = made.repartitionByRange(partitions(made), *keys, *order).sortWithinPartitions(*keys, *order)
    out = stored(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    more = out.withColumn("_part", F.shiftright("_at", 33))
    more.written_to = out.written_to
    return more


def starts_of(totals: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``totals(group, _part, value)``, a row for each group and partition -> what stands before each, as
    ``name``; null counts as 0."""
    keys = [F.col(f"`{c}`") for c in group] or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*(f"`{c}`" for c in group), "_part", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name))


def joined_to_parts(rows: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """Adds the columns of ``parts(group, _part, ...)`` to the rows of each group in each partition."""
    renamed = parts.select(F.col("_part").alias("_p2"), *(F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group)), *(f"`{c}`" for c in parts.columns if c not in [*group, "_part"]))
    on = F.col("_part") == F.col("_p2")
    for i, c in enumerate(group):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    return rows.join(renamed, on).drop("_p2", *(f"_g{i}" for i in range(len(group))))


def with_rank(rows: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds each row's gapless 0-based rank ``name`` in its group by ``order``; no task holds a group.
    Only the counts of groups in range partitions are summed up in a window. Without groups these are a row a
    partition, and go to all tasks."""
    dealt = by_range(rows, group, order, "rank")
    counts = dealt.groupBy("_part", *(f"`{c}`" for c in group)).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = starts_of(counts, group, "_n", "_before")
    parts = joined_to_parts(starts.select(*starts.columns), counts.select("_part", *(f"`{c}`" for c in group), "_first"), group)
    parts = parts if group else F.broadcast(parts)
    ranked = joined_to_parts(dealt, parts, group).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    return ranked.select(*(f"`{c}`" for c in rows.columns), name)


def sized(table: DataFrame, most: int = 20_000) -> DataFrame:
    """A table for the small side of a join: broadcast if a count shows that it is short, else merged, where
    Spark splits partitions of hot keys."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def forward_fill(rows: DataFrame, value: str, group: list[str], order: list[Column | str]) -> DataFrame:
    """``value`` of each row, or the last known one before it in its group. Rows are sorted over range
    partitions; each partition's last known value is carried to the next, so no task holds a group."""
    dealt = by_range(rows, group, order, "fill")
    last = dealt.groupBy(*(f"`{c}`" for c in group), "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy(*(f"`{c}`" for c in group)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carried = last.select(*(f"`{c}`" for c in group), "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy(*(f"`{c}`" for c in group), "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    filled = joined_to_parts(dealt.withColumn("_filled", F.last(value, ignorenulls=True).over(within)), carried, group)
    return filled.withColumn(value, F.coalesce("_filled", "_carried")).select(*(f"`{c}`" for c in rows.columns))


def with_running_sum(rows: DataFrame, group: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group before this one in order. Each range
    partition begins with the sums of those before it, so no task holds a group."""
    dealt = by_range(rows, group, order, "sums")
    keys = [f"`{c}`" for c in group]
    totals = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    within = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = joined_to_parts(dealt.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))), starts_of(totals, group, "_sum", "_start"), group)
    return summed.withColumn(name, F.col("_within") + F.col("_start")).select(*(f"`{c}`" for c in rows.columns), name)
