"""Wide sheets (years and months across, places down) -> long price rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, to_number
from .durable import forward_fill, sized, stored
from .filters import without_texts
from .summary import impute_means, rounded_ratio

# The categories of the price tables.
KNOWN_TYPES = (
    "Beans and Legumes", "Cereals", "Commercial Crops", "Condiments", "Fruit Vegetables", "Fruits",
    "Leafy Vegetables", "Livestock", "Poultry", "Rootcrops",
)
SHEET = ["file", "sheet"]


TRAILING = r"(?:\s*(?:" + "|".join(re.escape(k) for k in KNOWN_TYPES) + r"))+$"


def _named(c: Column) -> Column:
    """Stripped; blank and ``nan`` are null."""
    return F.nullif(F.nullif(strip(c), F.lit("")), F.lit("nan"))


def headers(cells: DataFrame) -> DataFrame:
    """Per sheet: width, the place ``head`` of its month row, and ``columns``, an array of (year, month) of
    the columns from the third on. Sheets without a year row have none.

    Rows that are all null don't count. The year row is, of the first five, the one with most cells that
    hold four digits; years are filled to the right, then to the left, months are not. Only the first
    six rows of each sheet leave their task.
    """
    rows = cells.filter(F.exists("cells", lambda x: x.isNotNull()))
    width = rows.groupBy(*SHEET).agg(F.max(F.size("cells")).alias("width"))
    first = rows.withColumn("row", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_idx")) - 1).filter(F.col("row") < 6)
    years = F.size(F.filter("cells", lambda x: x.rlike(r"\d{4}")))
    found = first.filter("row < 5").withColumn("n", years).filter("n > 0")
    found = found.groupBy(*SHEET).agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("year_row"))
    top = first.join(found, SHEET).join(width, SHEET).filter(F.col("row").between(F.col("year_row"), F.col("year_row") + 1))
    each = top.select(*SHEET, "width", "row_idx", "row", "year_row", F.explode(F.sequence(F.lit(0), F.col("width") - 3)).alias("col"), "cells").filter("width > 2")
    cell = F.get("cells", F.col("col") + 2)
    words = F.split(_named(cell), r"\s+")
    last = F.try_element_at(words, F.lit(-1))
    month = F.when((F.size(words) > 1) & last.rlike(r"(?U)^\p{Alpha}+$"), last).otherwise(_named(cell))
    is_year = F.col("row") == F.col("year_row")
    found_year = F.nullif(F.regexp_extract(cell, r"(\d{4})", 1), F.lit("")).cast("int")
    maps = each.groupBy(*SHEET, "width", "col").agg(
        F.max(F.when(is_year, found_year)).alias("year"), F.max(F.when(~is_year, month)).alias("month"), F.max(F.when(~is_year, F.col("row_idx"))).alias("head")
    )
    along = Window.partitionBy(*SHEET).orderBy("col")  # the header's cells only
    year = F.coalesce(F.last("year", True).over(along), F.first("year", True).over(along.rowsBetween(0, Window.unboundedFollowing)))
    maps = maps.withColumn("year", year).groupBy(*SHEET, "width").agg(F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("col", "year", "month"))).alias("columns"))
    return maps.filter("head IS NOT NULL AND columns[0].year IS NOT NULL")


def _commodities(data: DataFrame) -> DataFrame:
    """Per sheet: how many commodities it names, how many of them are categories, the first of those,
    whether all are cereals as a category, and whether any cell is not blank."""
    named = _named(F.col("commodity"))
    known = F.when(named == "Cereal", "Cereals").when(named.isin(*KNOWN_TYPES), named)
    each = data.groupBy(*SHEET, named.alias("named"), known.alias("known")).agg(F.min("row_idx").alias("at"), F.bool_or(F.coalesce(strip(F.col("commodity")), F.lit("")) != "").alias("some"))
    return each.groupBy(*SHEET).agg(
        F.count("named").alias("n"),
        F.count(F.when(F.col("known").isNotNull(), F.col("named"))).alias("n_known"),
        F.min_by("known", F.when(F.col("known").isNotNull(), F.col("at"))).alias("first_known"),
        F.bool_and(F.coalesce(F.col("named").isin("Cereals", "Cereal"), F.lit(True))).alias("cereal_only"),
        F.bool_or("some").alias("some"),
    )


def _price(c: Column) -> Column:
    """The number a price cell spells; a category's name after it goes, and marks of missing values are null."""
    s = strip(c)
    s = F.when(s.rlike("[a-z]$"), strip(F.regexp_replace(s, TRAILING, ""))).otherwise(s)
    return to_number(F.when(~s.isin("..", "-", "NA", ""), s))


def sheets_to_prices(cells: DataFrame, unwanted: list[str] | None = None, labels: list[str] | None = None, impute: bool = True) -> DataFrame:
    """``cells(file, sheet, row_idx, cells array<string>)`` -> Geolocation, Commodity, Commodity Type,
    Year, Month, Price with file, sheet, row and col.

    The type is the file name up to ``_``, unless all of at most two commodities are categories, of
    which the first is taken; commodities that are only "Cereals" become ``labels`` or the sheet's
    name. Places lose leading dots and are filled down in column-major order after cells with unwanted
    texts are gone. Missing prices become the mean of their sheet's commodity.

    Sheets may be of any length: places are filled over range partitions. Without unwanted texts a row's
    place is the same in every column (but for rows above the first place, which take the last one of
    the column before), and means are sums of row sums, so rows are spread into cells last of all.
    """
    head = stored(headers(cells), "headers")
    data = cells.filter(F.exists("cells", lambda x: x.isNotNull())).join(sized(head.select(*SHEET, "head")), SHEET).filter("row_idx > head")
    data = data.select(*SHEET, "row_idx", F.get("cells", F.lit(0)).alias("place"), F.get("cells", F.lit(1)).alias("commodity"), F.slice("cells", 3, 1 << 30).alias("values"))
    facts = stored(_commodities(data), "facts")
    prefix = F.split(F.element_at(F.split("file", "/"), -1), "_")
    kind = F.when((F.col("n") > 0) & (F.col("n") <= 2) & (F.col("n") == F.col("n_known")), F.col("first_known")).when(F.size(prefix) > 1, prefix[0]).otherwise("Commodity")
    given = [x.strip() for x in labels or [] if x and x.strip()]
    label = F.lit(", ".join(given[:5])) if given else F.nullif(strip(F.col("sheet")), F.lit(""))
    renamed = F.col("cereal_only") & (F.col("n") <= 2) & label.isNotNull()
    data = data.join(sized(facts), SHEET).filter(F.col("some") | renamed)
    data = data.select(*SHEET, "row_idx", "place", F.when(renamed, label).otherwise(F.col("commodity")).alias("commodity"), kind.alias("kind"), "values")
    place = lambda c: F.nullif(F.regexp_replace(c, r"^\.+", ""), F.lit(""))
    columns = sized(head.select(*SHEET, "columns"))
    names = [
        *SHEET, F.col("row_idx").alias("row"), F.col("c.col").alias("col"), F.col("place").alias("Geolocation"), F.col("commodity").alias("Commodity"),
        F.col("kind").alias("Commodity Type"), F.col("c.year").alias("Year"), F.col("c.month").alias("Month"),
    ]

    if unwanted:  # cells go one by one, and each column has fills of its own
        rows = data.join(columns, SHEET).withColumn("c", F.explode("columns"))
        long = without_texts(rows.select(*names, F.get("values", F.col("c.col")).alias("Price")), unwanted, ["Geolocation", "Commodity", "Commodity Type", "Year", "Month", "Price"])
        long = forward_fill(long.withColumn("Geolocation", place(F.col("Geolocation"))), "Geolocation", SHEET, ["col", "row"])
        long = long.filter("Geolocation IS NOT NULL AND Commodity IS NOT NULL").withColumn("Price", _price(F.col("Price")))
        return impute_means(long, [*SHEET, "Commodity"], "Price") if impute else long

    data = data.withColumns({"place": place(F.col("place")), "values": F.transform("values", _price)})
    ends = sized(data.groupBy(*SHEET).agg(F.max_by("place", F.when(F.col("place").isNotNull(), F.col("row_idx"))).alias("last_place")))
    data = forward_fill(data, "place", SHEET, ["row_idx"]).join(ends, SHEET).filter("commodity IS NOT NULL AND last_place IS NOT NULL")
    # Above the first place, the first column has none.
    top = F.col("place").isNull()
    data = data.withColumns({"skipped": top, "place": F.coalesce("place", "last_place")})
    price = F.get("values", F.col("c.col"))
    if impute:
        cents = F.transform(F.slice("values", F.when(F.col("skipped"), 2).otherwise(1), 1 << 30), lambda x: F.round(F.round(x, 2) * 100).cast("long"))
        some = F.filter(cents, lambda x: x.isNotNull())
        sums = data.groupBy(*SHEET, "commodity").agg(F.sum(F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x)).alias("_sum"), F.sum(F.size(some)).alias("_n"))
        data = data.join(sized(sums.withColumn("mean", rounded_ratio(F.col("_sum"), F.col("_n"), 2)).drop("_sum", "_n")), [*SHEET, "commodity"])
        price = F.when(F.col("mean").isNotNull(), F.round(F.coalesce(price, F.col("mean")), 2)).otherwise(price)
    rows = data.join(columns, SHEET).withColumn("c", F.explode("columns")).filter("NOT skipped OR c.col > 0")
    return rows.select(*names, price.alias("Price"))
