"""Raw rows -> normalised rows of yields, prices and corpus records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CORPUS_NAMESPACE, PRICE_NAMESPACE, YIELD_NAMESPACE, blank_to_null, row_id, sanitize, strip, to_number, to_year, url_key

ANNUAL = ("annual", "yearly", "year", "total")
# The two labels of the yield source.
SEMESTERS = {"1st Semester (Sept16-Mar15)": 1, "2nd Semester (Mar16-Sept15)": 2}
PRICE_COLUMNS = ("Geolocation", "Commodity Type", "Commodity", "Year", "Month", "Price")


def semester_code(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(strip(label).isin(*(k for k, v in SEMESTERS.items() if v == 1)), 1)
        .when(strip(label).isin(*(k for k, v in SEMESTERS.items() if v == 2)), 2)
        .when(low.contains("1st") | low.contains("first"), 1)
        .when(low.contains("2nd") | low.contains("second"), 2)
    )


def price_records(rows: DataFrame, order: list[str], source: str = "openstat") -> DataFrame:
    """Normalised prices -> corpus records: a sentence as text, input and content, source, doc_id with the
    row's number in ``order``, and place, commodity, type, year, month and price (null: no price)."""
    from ..functions import passages
    from .durable import with_rank

    wanted = [*dict.fromkeys([*order, "geolocation", "commodity_type", "commodity", "year", "month", "price_php_per_kg"])]
    ranked = with_rank(rows.select(*wanted), [], order, "_index")
    text = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit(""))
    said = ranked.withColumn("text", passages.price_sentence())
    return said.select(
        "text", F.col("text").alias("input"), F.col("text").alias("content"), F.lit(source).alias("source"), passages.price_doc_id(F.col("_index"), source).alias("doc_id"),
        text("geolocation").alias("geolocation"), F.coalesce(blank_to_null(F.col("commodity")), text("commodity_type")).alias("commodity"), text("commodity_type").alias("commodity_type"),
        "year", text("month").alias("month"), F.when(~F.isnan("price_php_per_kg"), F.col("price_php_per_kg")).alias("price"),
    )


def is_annual(month: Column) -> Column:
    return F.lower(strip(month)).isin(*ANNUAL)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def normalize_yields(raw: DataFrame, schema_version: str = "1", source: str = "prism") -> DataFrame:
    """String columns of the yield export -> typed rows; rows without year, semester, value, region or
    province are dropped, a blank municipality stays. Other columns (an order column, say) stay."""
    names = {"Year": "year", "Semester": "semester_label", "Region": "region", "Province": "province", "Municipality": "municipality"}
    value, scraped = "Average Yield (ton/ha)", "Date and time of Scraping"
    require_columns(raw, *names, value)
    rest = [c for c in raw.columns if c not in names and c not in (value, scraped)]
    at = strip(F.col(f"`{scraped}`")) if scraped in raw.columns else F.lit("")
    rows = raw.select(
        *rest,
        to_year(F.col("Year")).alias("year"),
        semester_code(F.col("Semester")).alias("semester_code"),
        strip(F.col("Semester")).alias("semester_label"),
        strip(F.col("Region")).alias("region"),
        strip(F.col("Province")).alias("province"),
        F.coalesce(strip(F.col("Municipality")), F.lit("")).alias("municipality"),
        F.round(to_number(F.col(f"`{value}`")), 4).alias("avg_yield_ton_ha"),
        F.replace(F.coalesce(at, F.lit("")), F.lit(" "), F.lit("T")).alias("scraped_at"),
        F.lit(source).alias("source"),
        F.lit(schema_version).alias("schema_version"),
    )
    return rows.filter("year is not null and semester_code is not null and avg_yield_ton_ha is not null and region != '' and province != ''")


def normalize_prices(raw: DataFrame, schema_version: str = "1", source: str = "openstat") -> DataFrame:
    """String columns of the price table -> typed rows; a missing price stays null, rows without place,
    commodity, year or month and annual rows are dropped. Other columns stay."""
    require_columns(raw, "Geolocation", "Year", "Month", "Price")
    rest = [c for c in raw.columns if c not in PRICE_COLUMNS]
    kind = F.coalesce(strip(F.col("`Commodity Type`")), F.lit("")) if "Commodity Type" in raw.columns else F.lit("")
    commodity = blank_to_null(F.col("Commodity")) if "Commodity" in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        *rest,
        strip(F.col("Geolocation")).alias("geolocation"),
        kind.alias("commodity_type"),
        F.coalesce(commodity, F.nullif(kind, F.lit(""))).alias("commodity"),
        to_year(F.col("Year"), lenient=True).alias("year"),
        strip(F.col("Month")).alias("month"),
        F.round(to_number(F.col("Price")), 2).alias("price_php_per_kg"),
        F.lit(source).alias("source"),
        F.lit(schema_version).alias("schema_version"),
    )
    return rows.filter("geolocation != '' and commodity is not null and year is not null and month != ''").filter(~is_annual(F.col("month")))


def with_yield_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("point_id", row_id(YIELD_NAMESPACE, "year", "semester_code", "region", "province", "municipality"))


def with_price_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("point_id", row_id(PRICE_NAMESPACE, "geolocation", "commodity", "year", "month"))


def corpus_payload(records: DataFrame, source_id: str | Column) -> DataFrame:
    """Records -> payloads with point_id; both text and doc_id are required, blank optionals are null."""
    have = set(records.columns)
    optional = [blank_to_null(F.col(c)).alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("url", "title", "filename")]
    source = source_id if isinstance(source_id, Column) else F.lit(source_id)
    rows = records.select(
        source.alias("source_id"),
        blank_to_null(F.col("doc_id").cast("string")).alias("doc_id"),
        blank_to_null(F.col("text")).alias("text"),
        *optional,
        (F.col("page").try_cast("int") if "page" in have else F.lit(None).cast("int")).alias("page"),
    ).filter("doc_id is not null and text is not null")
    return rows.withColumn("point_id", row_id(CORPUS_NAMESPACE, "source_id", "doc_id"))


def corpus_record(text: Column, source: str | Column, doc_id: Column, **extra: Column) -> Column:
    """Struct of a corpus record: the cleaned text as text, input and content."""
    clean = sanitize(text)
    source = source if isinstance(source, Column) else F.lit(source)
    return F.struct(clean.alias("text"), clean.alias("input"), clean.alias("content"), source.alias("source"), doc_id.alias("doc_id"), *(c.alias(k) for k, c in extra.items()))


def tag_source(rows: DataFrame, url: Column) -> DataFrame:
    return rows.withColumn("Source URL", url_key(url))


def ordered_columns(table: DataFrame) -> DataFrame:
    """Known price columns first, then Source URL, then the rest; a missing Commodity is the type."""
    if "Commodity" not in table.columns and "Commodity Type" in table.columns:
        table = table.withColumn("Commodity", F.col("`Commodity Type`"))
    first = [c for c in (*PRICE_COLUMNS, "Source URL") if c in table.columns]
    return table.select(*(f"`{c}`" for c in [*first, *(c for c in table.columns if c not in first)]))


def export_yields(grid: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Grid rows with the parsed rows of their key; a key without any gives one zero row."""
    joined = grid.join(parsed, keys, "left")
    return joined.withColumns({"municipality": F.coalesce("municipality", F.lit("")), "yield_text": F.coalesce(F.col("value").cast("string"), F.lit("0"))}).drop("value")
