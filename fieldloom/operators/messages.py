"""Rules over message texts: intent, language, crop, years, places; and the summaries they ask for."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any
from .summary import rounded_ratio, valid_yields

# The words that decide, in the order in which intents are tried.
INTENTS = {
    "developer_task": ("api", "scraper", "qdrant", "implement", "debug", "testing", "unit test", "phase", "tasklist"),
    "price_query": ("magkano", "presyo", "price", "farmgate", "market price"),
    "yield_query": ("ani", "yield", "production", "mababa ani", "harvest"),
    "paper_query": (
        "paper", "papers", "publication", "publications", "research", "study", "studies", "journal", "pdf", "document",
        "dokumento", "babasan", "babasahin",
    ),
    "news_query": ("balita", "news", "latest", "newest", "recent", "update"),
    "advisory_query": (
        "sakit", "peste", "insekto", "dahon", "pataba", "fertilizer", "paano", "ano gagawin", "anong gagawin", "tanim", "pananim",
    ),
}
TAGALOG = ("ano", "magkano", "palay", "ani", "balita", "peste", "sakit", "tanim", "pataba", "bakit", "paano")
CROPS = {"palay": ("palay", "rice", "bigas"), "corn": ("mais", "corn")}
SOURCES = {
    "news_query": ("philrice_news", "irri"),
    "paper_query": ("philrice", "pinoyrice"),
    "advisory_query": ("philrice_news", "irri", "philrice", "pinoyrice"),
}
LAST_YEAR = ("last year", "nakaraang taon", "last season")
THIS_YEAR = ("this year", "ngayon", "current year", "kasalukuyang taon")
# Words of requests to look around, and of requests for numbers.
EXPLORING = ("hanap", "maghanap", "search", "records", "record")
NUMERIC = ("average", "avg", "mean", "highest", "lowest", "trend", "total", "magkano")
# The provinces, in the order in which they are tried.
PLACES = (
    "Abra", "Agusan del Norte", "Agusan del Sur", "Aklan", "Albay", "Antique", "Apayao", "Aurora", "Bataan", "Batanes",
    "Batangas", "Benguet", "Biliran", "Bohol", "Bukidnon", "Bulacan", "Cagayan", "Camarines Norte", "Camarines Sur",
    "Camiguin", "Capiz", "Catanduanes", "Cavite", "Cebu", "Cotabato", "Davao de Oro", "Davao del Norte", "Davao del Sur",
    "Davao Occidental", "Davao Oriental", "Dinagat Islands", "Eastern Samar", "Guimaras", "Ifugao", "Ilocos Norte",
    "Ilocos Sur", "Iloilo", "Isabela", "Kalinga", "La Union", "Laguna", "Lanao del Norte", "Lanao del Sur", "Leyte",
    "Maguindanao", "Marinduque", "Masbate", "Misamis Occidental", "Misamis Oriental", "Mountain Province",
    "Negros Occidental", "Negros Oriental", "Northern Samar", "Nueva Ecija", "Nueva Vizcaya", "Occidental Mindoro",
    "Oriental Mindoro", "Palawan", "Pampanga", "Pangasinan", "Quezon", "Quirino", "Rizal", "Romblon", "Samar", "Sarangani",
    "Siquijor", "Sorsogon", "South Cotabato", "Southern Leyte", "Sultan Kudarat", "Sulu", "Surigao del Norte",
    "Surigao del Sur", "Tarlac", "Tawi-Tawi", "Zambales", "Zamboanga del Norte", "Zamboanga del Sur", "Zamboanga Sibugay",
)


def _first(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = reduce(lambda acc, c: acc.when(*c) if acc is not None else F.when(*c), cases, None)
    return out if otherwise is None else out.otherwise(otherwise)


def intent(text: Column) -> Column:
    low = F.lower(text)
    return _first([(contains_any(low, w), F.lit(k)) for k, w in INTENTS.items()], F.lit("unclear_query"))


def language(text: Column) -> Column:
    return F.when(contains_any(F.lower(text), TAGALOG), "taglish").otherwise("en")


def crop(text: Column) -> Column:
    low = F.lower(text)
    return _first([(contains_any(low, w), F.lit(k)) for k, w in CROPS.items()])


def commodity_of(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*CROPS["palay"]), "Palay").when(low.isin(*CROPS["corn"]), "Corn").otherwise(F.nullif(F.trim(c), F.lit("")))


def place(text: Column, places: tuple[str, ...] = PLACES) -> Column:
    """First name of the list that stands in the text as whole words.

    One pattern looks at each place of the text and finds, of the names that begin there, the first of the list
    (the list is its order of trying), without moving on, so that names within names are found too."""
    if not places:
        return F.lit(None).cast("string")
    low = [p.lower() for p in places]
    by_letter: dict[str, list[str]] = {}  # names that begin with another letter begin elsewhere, so order stays
    for p in low:
        rest, word = re.escape(p[1:]), re.escape(p)
        ends = (rf"(?<!\w{word})" if re.match(r"\w", p) else "") + (r"(?!\w)" if re.search(r"\w$", p) else "")  # looked at in found names only
        by_letter.setdefault(p[0], []).append(rest + ends)
    each = [(re.match(r"\w", c), f"{re.escape(c)}(?:{'|'.join(rests)})") for c, rests in by_letter.items()]
    words, others = "|".join(b for word, b in each if word), "|".join(b for word, b in each if not word)
    whole = "|".join(x for x in (f"(?<![a-z0-9_])(?:{words})" if words else "", others) if x)  # most places go by a plain class
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?U)(?=({whole}))"), F.lit(1))
    first = F.array_min(F.transform(found, lambda x: F.array_position(F.array(*(F.lit(p) for p in low)), x)))
    return F.get(F.array(*(F.lit(p) for p in places)), (first - 1).cast("int"))


def years(text: Column, today_year: int) -> Column:
    """Struct (year_min, year_max): of two years in the text both, else one, else relative words."""
    low = F.lower(text)
    # The patterns of years and of "years ago" in both languages.
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(19\d{2}|20\d{2}|21\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    found = F.filter(found, lambda y: y <= 2100)
    ago = F.coalesce(
        F.nullif(F.regexp_extract(low, r"\b(\d{1,2})\s+years?\s+ago\b", 1), F.lit("")),
        F.nullif(F.regexp_extract(low, r"\b(\d{1,2})\s+taon\s+(?:na\s+)?(?:nakaraan|ang nakalipas)\b", 1), F.lit("")),
    ).cast("int")
    pair = lambda a, b: F.struct(a.cast("int").alias("year_min"), b.cast("int").alias("year_max"))
    now = F.lit(today_year)
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    return (
        F.when(F.size(found) >= 2, pair(F.least(first, second), F.greatest(first, second)))
        .when(F.size(found) == 1, pair(first, first))
        .when(ago.isNotNull(), pair(now - ago, now - ago))
        .when(contains_any(low, LAST_YEAR), pair(now - 1, now - 1))
        .when(contains_any(low, THIS_YEAR), pair(now, now))
    )


def preferred_query(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    looking = contains_any(low, EXPLORING) & ~contains_any(low, NUMERIC)
    return (
        F.when(kind == "price_query", F.when(looking, "search_prices").otherwise("summarize_prices"))
        .when(kind == "yield_query", F.when(looking, "search_yield_knowledge").otherwise("summarize_yield"))
        .when(kind.isin("news_query", "paper_query", "advisory_query"), "search_corpus")
        .otherwise("none")
    )


def annotate(messages: DataFrame, today_year: int, text_col: str = "text", places: tuple[str, ...] = PLACES) -> DataFrame:
    """Messages with intent, language, crop, commodity, place, years, what is missing, the sources to
    search and the preferred query."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = messages.withColumns({"intent": intent(t), "language": language(t), "crop": crop(t), "place": place(t, places), "years": years(t, today_year)})
    missing = (
        F.when(F.col("intent").isin("price_query", "yield_query") & F.col("place").isNull(), "place")
        .when((F.col("intent") == "advisory_query") & F.col("crop").isNull(), "crop")
        .when(F.col("intent") == "unclear_query", "intent")
    )
    sources = _first([(F.col("intent") == k, F.array(*(F.lit(x) for x in v))) for k, v in SOURCES.items()])
    return out.withColumns({"missing": missing, "source_ids": sources, "commodity": commodity_of(F.col("crop")), "preferred": preferred_query(F.col("intent"), t)})


def message_counts(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("intent", "language", "preferred").agg(F.count("*").alias("messages"))


def _running_years(rows: DataFrame, keys: list[str], units: Column) -> DataFrame:
    """For each subset of ``keys``, null where any value will do (``any`` says which, as bits): an array of
    (year, rows up to it, sum up to it), by year."""
    sums = rows.cube(*keys, "year").agg(F.grouping_id().cast("int").alias("g"), F.count("*").alias("n"), F.sum(units).alias("s")).filter("g % 2 = 0")
    till = Window.partitionBy("g", *keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # a row a year
    sums = sums.withColumns({"n": F.sum("n").over(till), "s": F.sum("s").over(till)})
    return sums.groupBy(F.expr("g div 2").cast("int").alias("any"), *keys).agg(F.sort_array(F.collect_list(F.struct("year", "n", "s"))).alias("till"))


def _answers(asked: DataFrame, rows: DataFrame, keys: dict[str, str], units: Column, places: int, count: str, mean: str) -> DataFrame:
    """Distinct requests (columns ``keys``, ``y0``, ``y1``; null: any) with the number and mean of the rows that
    they mean. ``keys``: column of the requests -> column of the rows. A request of any span of years is
    one row, which meets one row of sums and takes the difference of two of its years."""
    known = _running_years(rows, list(keys.values()), units)
    bits = [F.col(c).isNull().cast("int") * (1 << (len(keys) - 1 - i)) for i, c in enumerate(keys)]
    left, right = asked.distinct().withColumn("any", reduce(lambda a, b: a + b, bits)).alias("a"), known.alias("p")
    on = F.col("a.any") == F.col("p.any")
    for a, p in keys.items():
        on = on & F.col(f"a.{a}").eqNullSafe(F.col(f"p.{p}"))
    up_to = lambda y: F.try_element_at(F.filter("p.till", lambda x: x.year <= y), F.lit(-1))
    last = F.when(F.col("a.y1").isNull(), F.try_element_at("p.till", F.lit(-1))).otherwise(up_to(F.col("a.y1")))
    before = F.when(F.col("a.y0").isNotNull(), up_to(F.col("a.y0") - 1))
    found = left.join(right, on, "left").select(*(f"a.{c}" for c in keys), "a.y0", "a.y1", *((F.coalesce(last[c], F.lit(0)) - F.coalesce(before[c], F.lit(0))).alias(c) for c in "ns"))
    return found.select(*keys, "y0", "y1", F.col("n").alias(count), rounded_ratio(F.col("s"), F.col("n"), places).alias(mean))


def answer_price_queries(annotated: DataFrame, prices: DataFrame) -> DataFrame:
    """``place, commodity, y0, y1, priced_rows, avg_price`` of each distinct request among messages that ask
    for a price summary; a null place, commodity or range of years is any."""
    asked = annotated.filter("preferred = 'summarize_prices'").select("place", "commodity", F.col("years.year_min").alias("y0"), F.col("years.year_max").alias("y1"))
    cents = F.round(F.col("price_php_per_kg") * 100).cast("long")
    keys = {"place": "geolocation", "commodity": "commodity"}
    return _answers(asked, prices.filter("price_php_per_kg IS NOT NULL AND year IS NOT NULL"), keys, cents, 2, "priced_rows", "avg_price")


def answer_yield_queries(annotated: DataFrame, yields: DataFrame) -> DataFrame:
    """``place, y0, y1, row_count, avg_yield`` of each distinct request among messages that ask for a yield
    summary; a place is a province, and a null place or range of years is any."""
    asked = annotated.filter("preferred = 'summarize_yield'").select("place", F.col("years.year_min").alias("y0"), F.col("years.year_max").alias("y1"))
    units = F.round(F.col("avg_yield_ton_ha") * 10000).cast("long")
    return _answers(asked, valid_yields(yields), {"place": "province"}, units, 4, "row_count", "avg_yield")
