"""Helpers every operator of this package uses: durable intermediate tables and global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import discard, new_path, partitions
from ..operators.durable import stored as materialize

__all__ = ["discard", "materialize", "new_path", "partitions", "spare", "with_rank"]


def spare(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores in front as it takes to be none of the ``taken`` names; case
    doesn't set names apart."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def with_rank(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds to each row its gapless 0-based rank ``name`` within ``group`` by ``order``.

    A range partitioning by (group, order) sorts all rows without any single task holding a group;
    the rows of each group in each partition are counted, and only these counts (at most
    partitions x groups rows) are summed up in a window. The sorted rows are written first, so that
    both passes see one and the same partitioning.
    """
    n = partitions(df)
    keys = [F.col(c) for c in group]
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "rank")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    safe = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    counts = rows.groupBy("_part", *safe).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    names = [f"_g{i}" for i in range(len(group))]
    if names:
        before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    else:  # one row a partition
        before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.withColumnRenamed("_part", "_part2")
    on = F.col("_part") == F.col("_part2")
    for c, s in zip(group, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(s))
    ranked = rows.join(counts, on).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    return ranked.select(*df.columns, name)
