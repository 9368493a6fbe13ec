"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any ordered type -> ``(node, label)``, label the smallest node reachable.

    Every step is joins and minima keyed by node: no neighbourhood is ever collected, so a node that
    holds a third of all edges only makes a join that Spark can split. The edges of each round are
    written to the shared folder. No edges give no rows; loops and repeated edges do no harm.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(h, 32))).first())

    now = materialize(tidy(edges.select("a", "b")), "edges")
    before = state(now)
    if before[0]:
        for _ in range(rounds):
            now = materialize(tidy(_small_star(tidy(_large_star(now)))), "edges")
            after = state(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
