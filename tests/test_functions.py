import uuid

from pyspark.sql import functions as F

from fieldloom.functions import dates, passages, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_uuid5_is_pythons(spark):
    for raw in ("2018|1|CAR|Abra|Bangued", "ñ|é", ""):
        want = str(uuid.uuid5(uuid.UUID(text.YIELD_NAMESPACE), raw))
        assert one(spark, text.uuid5(text.YIELD_NAMESPACE, F.col("r")), r=raw) == want


def test_numbers_and_years(spark):
    n = lambda s: one(spark, text.to_number(F.col("s")), s=s)
    assert (n(" 3.50 "), n("5d"), n("nan"), n(""), n("-.5e1")) == (3.5, None, None, None, -5.0)
    assert one(spark, text.to_year(F.col("s")), s="2018.0") is None
    assert one(spark, text.to_year(F.col("s"), lenient=True), s="2018.0") == 2018


def test_sanitize_and_lines(spark):
    assert one(spark, text.sanitize(F.col("s")), s="  a b\r\nc\rd\x0ce\x85 ") == "a b\nc\nd e"
    assert one(spark, text.lines(F.col("s")), s="a\r\nb\x0bc d\n") == ["a", "b", "c", "d"]


def test_urls(spark):
    assert one(spark, text.url_key(F.col("u")), u="https://OpenData.Example.ORG/DB/DB__1/?x=1") == "https://opendata.example.org/DB/DB__1"
    assert one(spark, text.id_from_url(F.col("u")), u="http://x.y/a b/ñ.html?q") == "a_b_ñ.html"
    assert one(spark, text.url_slug(F.col("u")), u="https://x.y/news/Rice--Day!/").startswith("rice--day_")
    assert one(spark, text.url_slug(F.col("u")), u="https://x.y/") == ""
    assert one(spark, text.seed_urls(F.col("u")), u="https://a.example/x, https://b.example/y ftp://c") == ["https://a.example/x", "https://b.example/y"]
    assert one(spark, text.app_url(F.col("u"), "maps.example"), u="https://maps.example/dataproducts/x") == "https://maps.example/wp-dynamicreports"


def test_tokens_and_titles(spark):
    assert one(spark, text.safe_token(F.col("s")), s=" Corngrain (Maize) White ") == "corngrain_maize_white"
    assert one(spark, text.safe_token(F.col("s"), "geo"), s="...") == "geo"
    assert one(spark, text.title_slug(F.col("s")), s="Rice Research Highlights 2024") == "rice_research_highlights_2024"


def test_dates(spark):
    d = lambda s: one(spark, dates.date_in_text(F.col("s")), s=s)
    assert (d("x\nMay 30, 2018"), d("06 February 2018 y"), d("3rd June 2020"), d("on May 30, 2018")) == ("2018-05-30", "2018-02-06", "2020-06-03", None)
    assert one(spark, dates.posted_date(F.col("s")), s="Posted on Mar - 11 - 2026") == "2026-03-11"
    assert one(spark, dates.short_to_iso(F.col("s")), s="03-11-26") == "2026-03-11"
    found = one(spark, dates.first_valid_date(F.col("a"), F.col("b")), a="x 2023-02-31", b="2024/05/06")
    assert str(found) == "2024-05-06"


def test_passages(spark):
    row = dict(geolocation="Abra", commodity_type="Cereals", commodity="Corngrain (Maize) White, matured", year=2023, month="August", price_php_per_kg=61.63)
    s = one(spark, passages.price_passage(), **row)
    assert "August 2023" in s and "₱61.63 per kilogram" in s and s.endswith("(Source: PSA OpenSTAT, Cereals)")
    row["price_php_per_kg"] = None
    df = spark.range(1).select(*(F.lit(v).cast("double" if k.startswith("price") else "string").alias(k) for k, v in row.items()))
    assert "had no recorded data." in df.select(passages.price_sentence()).first()[0]
    y = dict(year=2018, semester_label="1st Semester", region="CAR", province="Abra", municipality="", avg_yield_ton_ha=0.0, scraped_at="2026-05-08T11:04:25")
    s = one(spark, passages.yield_passage(), **y)
    assert "(unknown municipality), in Abra, CAR" in s and "0.00 ton/ha" in s and "scraped 2026-05-08" in s


def test_safe_token_leaves_patterns_to_rare_strings(spark):
    from pyspark.sql import functions as F

    from fieldloom.functions import text as T

    values = ["United States", "Brand#11", "a  b", "a__b", " nan ", "!nan", "__", None, "Ñame 1", "x" * 90, "-", "a\tb"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.t for r in rows.select(T.safe_token(F.col("v")).alias("t")).collect()]
    assert got == ["united_states", "brand_11", "a_b", "a__b", "unknown", "nan", "unknown", "unknown", "ame_1", "x" * 80, "-", "a_b"]
    said = T.safe_token(F.col("v"))._jc.toString()
    assert said.count("regexp_replace") == 1  # it was written out four times
