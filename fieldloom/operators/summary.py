"""Summaries and metadata of normalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ("region", "province", "municipality")


def mean_of(value: str | Column, places: int) -> Column:
    """Average, rounded half up, of values with at most ``places`` decimals: summed as whole units, so
    the result is the same in whatever order parts are added."""
    c = F.col(value) if isinstance(value, str) else value
    units = F.round(c * 10**places).cast("long")
    return rounded_ratio(F.sum(units), F.count(units), places)


def rounded_ratio(total: Column, n: Column, places: int) -> Column:
    """``total`` units over ``n``, rounded half up to whole units, as a number with ``places`` decimals."""
    a, b = 2 * total + n, 2 * n
    return F.when(n > 0, (a - F.pmod(a, F.when(n > 0, b))) / F.when(n > 0, b) / 10**places)


def valid_yields(rows: DataFrame) -> DataFrame:
    return rows.filter("year is not null and semester_code in (1, 2) and avg_yield_ton_ha is not null")


def yield_summary(rows: DataFrame) -> DataFrame:
    """Overall, by year and by (year, semester) in one pass: ``level`` all, year or semester."""
    rows = valid_yields(rows)
    sets = rows.groupingSets([[], ["year"], ["year", "semester_code"]], "year", "semester_code")
    out = sets.agg(mean_of("avg_yield_ton_ha", 4).alias("avg_yield"), F.count("*").alias("row_count"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "year").otherwise("semester")
    return out.select(level.alias("level"), "year", "semester_code", F.coalesce("avg_yield", F.lit(0.0)).alias("avg_yield"), "row_count")


def municipality_count(rows: DataFrame) -> DataFrame:
    named = valid_yields(rows).filter("municipality != ''")
    return named.agg(F.count_distinct("province", "municipality").alias("municipality_count"))


def extreme(value: str, key: str, columns: tuple[str, ...], largest: bool) -> Column:
    """Struct of the row with the smallest (largest) value; ties go to the smaller key."""
    order = F.struct((-F.col(value) if largest else F.col(value)).alias("v"), F.col(key).alias("k"))
    return F.min_by(F.struct(*columns, value), F.when(F.col(value).isNotNull(), order))


def yield_extremes(rows: DataFrame) -> DataFrame:
    columns = ("year", "semester_code", *PLACE)
    found = valid_yields(rows).agg(*(extreme("avg_yield_ton_ha", "point_id", columns, m).alias(n) for n, m in (("min", False), ("max", True))))
    return found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("r")) for n in ("min", "max")))).alias("x")).select("x.kind", "x.r.*")


def price_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with year and month, those with a price, and average, least and largest price, by columns."""
    valid = rows.filter("year is not null and month is not null")
    return valid.groupBy(*by).agg(
        F.count("*").alias("row_count"),
        F.count("price_php_per_kg").alias("priced_row_count"),
        F.coalesce(mean_of("price_php_per_kg", 2), F.lit(0.0)).alias("avg_price"),
        F.min("price_php_per_kg").alias("min_price"),
        F.max("price_php_per_kg").alias("max_price"),
    )


def price_by_month(rows: DataFrame) -> DataFrame:
    """Over rows with a price only; months in alphabetical order."""
    return price_summary(rows.filter("price_php_per_kg is not null"), "year", "month").select("year", "month", "row_count", "avg_price").orderBy("year", "month")


def price_extremes(rows: DataFrame) -> DataFrame:
    columns = ("geolocation", "commodity", "year", "month")
    valid = rows.filter("year is not null and month is not null")
    found = valid.agg(*(extreme("price_php_per_kg", "point_id", columns, m).alias(n) for n, m in (("min", False), ("max", True))))
    return found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("r")) for n in ("min", "max")))).alias("x")).select("x.kind", "x.r.*")


def nested_values(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Sorted distinct inner values of each outer value: the pairs are made distinct before any set."""
    pairs = rows.select(outer, inner).filter(F.col(outer).isNotNull() & (F.col(inner) != "")).distinct()
    return pairs.groupBy(outer).agg(F.sort_array(F.collect_list(inner)).alias(f"{inner}_list"), F.count("*").alias(f"{inner}_count"))


def yield_metadata(rows: DataFrame) -> DataFrame:
    """One row: years, regions, region -> provinces, region -> province -> municipalities."""
    places = rows.select("region", "province", "municipality").distinct()
    provinces = places.groupBy("region", "province").agg(F.sort_array(F.collect_set(F.nullif("municipality", F.lit("")))).alias("m"))
    regions = provinces.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("province", "m"))).alias("p"))
    maps = regions.agg(
        F.array_sort(F.collect_list("region")).alias("regions"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", F.col("p.province"))))).alias("region_to_provinces"),
        F.map_from_entries(F.collect_list(F.struct("region", F.map_from_entries("p")))).alias("municipalities"),
    )
    years = rows.agg(F.sort_array(F.collect_set("year")).alias("years"), F.count("*").alias("row_count"))
    return years.join(maps)  # one row each


def price_metadata(rows: DataFrame) -> DataFrame:
    """One row: years, months, places, types (blank: "(unspecified)") and type -> commodities."""
    kind = F.when(F.col("commodity_type") == "", "(unspecified)").otherwise(F.col("commodity_type"))
    typed = nested_values(rows.withColumn("commodity_type", kind), "commodity_type", "commodity")
    types = typed.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("commodity_type", "commodity_list")))).alias("type_to_commodities"))
    sets = rows.agg(*(F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("year", "month", "geolocation")), F.count("*").alias("row_count"))
    return sets.join(types)  # one row each


def collection_stats(**tables: DataFrame) -> DataFrame:
    """Points and schema version of each named table."""
    parts = [t.agg(F.lit(n).alias("collection"), F.count("*").alias("points"), F.max("schema_version").alias("schema_version")) for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def impute_means(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Missing values become their group's mean, and all values of a group with any are rounded."""
    means = rows.groupBy(*group).agg(mean_of(F.round(value, 2), 2).alias("_mean"))
    # An aggregate and a join, not a window: a large group is summed in parts first.
    joined = rows.join(means.select(*(F.col(c).alias(f"_{c}") for c in group), "_mean"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    filled = F.when(F.col("_mean").isNotNull(), F.round(F.coalesce(value, "_mean"), 2)).otherwise(F.col(value))
    return joined.select(*(filled.alias(c) if c == value else F.col(c) for c in rows.columns))
