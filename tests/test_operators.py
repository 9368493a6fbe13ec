import json
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import corpus as C
from fieldloom.operators import html as H
from fieldloom.operators import merge as M
from fieldloom.operators import messages as G
from fieldloom.operators import reshape as R
from fieldloom.operators import search as S
from fieldloom.operators import summary as A
from fieldloom.operators import validate as V
from fieldloom.operators.filters import PriceFilter, YieldFilter, next_offset, without_texts
from fieldloom.operators.normalize import normalize_prices, normalize_yields, with_price_id
from fieldloom.sources import readers, sinks
from fieldloom.streaming import ingest

YIELD = "Year string, Semester string, Region string, Province string, Municipality string, `Average Yield (ton/ha)` string, `Date and time of Scraping` string"
PRICE = "Geolocation string, `Commodity Type` string, Commodity string, Year string, Month string, Price string"


def test_normalize_yields(spark):
    raw = [
        ("2018", "1st Semester (Sept16-Mar15)", "CAR", "Abra", "Bangued", "3.03", "2026-05-08 11:04:25"),
        ("2019", "second half", "CAR", " Abra ", None, "4.0", ""),
        ("abc", "1st Semester (Sept16-Mar15)", "CAR", "Abra", "Bangued", "3.03", ""),
        ("2019", "x", "CAR", "Abra", "Bangued", "3.03", ""),
    ]
    rows = normalize_yields(spark.createDataFrame(raw, YIELD)).orderBy("year").collect()
    assert [(r.year, r.semester_code, r.municipality, r.avg_yield_ton_ha) for r in rows] == [(2018, 1, "Bangued", 3.03), (2019, 2, "", 4.0)]
    assert rows[0].scraped_at == "2026-05-08T11:04:25"


def test_normalize_prices(spark):
    raw = [("Abra", "Cereals", "Palay", "2023.0", "August", "24.0"), ("Abra", "Cereals", "", "2023", "May", ".."), ("Abra", "Cereals", "Palay", "2023", " annual ", "20"), ("", "C", "P", "2023", "May", "1")]
    rows = normalize_prices(spark.createDataFrame(raw, PRICE)).orderBy("month").collect()
    assert [(r.month, r.commodity, r.price_php_per_kg) for r in rows] == [("August", "Palay", 24.0), ("May", "Cereals", None)]
    ids = with_price_id(normalize_prices(spark.createDataFrame(raw, PRICE))).select("point_id").distinct().count()
    assert ids == 2
    with pytest.raises(ValueError):
        normalize_prices(spark.createDataFrame([("a",)], "Geolocation string"))


def test_filters(spark):
    with pytest.raises(ValueError):
        YieldFilter(year_min=2020, year_max=2019)
    assert YieldFilter(region="  ").region is None
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 5.0)], "geolocation string, price_php_per_kg double")
    assert df.filter(PriceFilter(price_min=0.5).condition()).count() == 2
    assert df.filter(PriceFilter().condition()).count() == 3
    assert without_texts(df, []).count() == 3 and without_texts(df, ["b"]).count() == 2
    assert next_offset(4, 0, 2) == 2 and next_offset(2, 0, 2) is None


def test_yield_summary_and_extremes(spark):
    rows = [(2019, 1, 3.0, "Bangued"), (2019, 2, 5.0, "Bucay"), (2020, 1, 4.0, "Bangued"), (2020, 2, 6.0, "Bucay"), (None, 1, 9.0, "x"), (2020, 3, 9.0, "x")]
    df = spark.createDataFrame(rows, "year int, semester_code int, avg_yield_ton_ha double, municipality string").withColumns(
        {"region": F.lit("CAR"), "province": F.lit("Abra"), "point_id": F.col("municipality")}
    )
    got = {(r.level, r.year, r.semester_code): (r.avg_yield, r.row_count) for r in A.yield_summary(df).collect()}
    assert got[("all", None, None)] == (4.5, 4) and got[("year", 2019, None)] == (4.0, 2) and got[("semester", 2020, 2)] == (6.0, 1)
    assert A.municipality_count(df).first()[0] == 2
    ends = {r.kind: (r.avg_yield_ton_ha, r.semester_code) for r in A.yield_extremes(df).collect()}
    assert ends == {"min": (3.0, 1), "max": (6.0, 2)}
    empty = A.yield_summary(df.limit(0)).collect()
    assert all(r.row_count == 0 and r.avg_yield == 0.0 for r in empty)


def test_upsert_is_idempotent_and_last_wins(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "point_id string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 1, 1)], "point_id string, v int, seq int")
    once = M.upsert(old, new, seq="seq")
    assert sorted((r.point_id, r.v) for r in once.collect()) == [("a", 1), ("b", 3), ("c", 1)]
    assert sorted(M.upsert(once, new, seq="seq").collect()) == sorted(once.collect())


def test_price_merge_cases(spark):
    schema = PRICE + ", `Source URL` string, seq int"
    old = spark.createDataFrame([("Region I", "Cereals", "Palay", "2024", "January", "25", "a", 1)], schema)
    new = spark.createDataFrame([("Region II", "Rootcrops", "Cassava", "2024", "February", "18", "b", 1)], schema)
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "u string")
    names = lambda df: sorted(r.Commodity for r in df.collect())
    assert M.merge_prices(None, None, None, resume=False) is None
    assert names(M.merge_prices(old, new, urls("b"), resume=True)) == ["Cassava", "Palay"]
    assert names(M.merge_prices(old, new, urls("a"), resume=True)) == ["Cassava"]
    assert names(M.merge_prices(old, new, urls("b"), resume=False)) == ["Cassava"]
    assert names(M.merge_prices(old.drop("Source URL"), None, None, resume=True)) == ["Palay"]


def test_keys_work_and_names(spark):
    done = spark.createDataFrame([("2024|1|14|101",)], "key string")
    work = spark.createDataFrame([("2024|1|14|101",), ("2024|2|14|101",)], "key string")
    assert [r.key for r in M.pending(work, done).collect()] == ["2024|2|14|101"]
    rows = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "base string, n int")
    taken = spark.createDataFrame([("u",)], "base string")
    assert [r.unique_name for r in M.unique_names(rows, "base", "n", taken).orderBy("n").collect()] == ["t", "t_2", "u_2"]
    by_url = spark.createDataFrame([("x", 1), ("x", 2), ("", 3), (None, 4)], "url string, n int")
    assert sorted(r.n for r in M.keep_first_by_url(by_url, "n").collect()) == [1, 3, 4]
    positions = M.urls_by_position(spark.createDataFrame([(["a", "b"],)], "urls array<string>"), spark.createDataFrame([(0,), (1,), (9,)], "position int"))
    assert sorted(r.url for r in positions.collect()) == ["a", "b"]
    index = M.running_index(spark.range(100).withColumn("k", -F.col("id")), ["k"])
    assert [r["index"] for r in index.orderBy("k").collect()] == list(range(100))


def test_sheets(spark):
    rows = [
        ("Cereals_x.xlsx", "Palay", 0, [None, None, None, None]),
        ("Cereals_x.xlsx", "Palay", 1, [None, None, "2020", None]),
        ("Cereals_x.xlsx", "Palay", 2, [None, None, "2020 January", "February"]),
        ("Cereals_x.xlsx", "Palay", 3, ["..Abra", "Palay", "10.5", "20.3"]),
        ("Cereals_x.xlsx", "Palay", 4, ["", "Palay", "..", "30.3"]),
        ("Cereals_x.xlsx", "Palay", 5, ["drop me", "Palay", "1", "1"]),
        ("Other.xlsx", "none", 0, ["a", "b"]),
    ]
    cells = spark.createDataFrame(rows, "file string, sheet string, row_idx int, cells array<string>")
    got = [(r.Geolocation, r.Year, r.Month, r.Price, r["Commodity Type"]) for r in R.sheets_to_prices(cells, ["drop me"]).orderBy("col", "row").collect()]
    assert got == [("Abra", 2020, "January", 10.5, "Cereals"), ("Abra", 2020, "January", 20.37, "Cereals"), ("Abra", 2020, "February", 20.3, "Cereals"), ("Abra", 2020, "February", 30.3, "Cereals")]
    assert R.sheets_to_prices(cells, []).count() == 6


def test_sheets_with_and_without_unwanted_texts_agree(spark):
    """Row by row and cell by cell give the same, and places are filled across partitions as column by column."""
    rnd = random.Random(6)
    rows, want = [], []
    for sheet in range(5):
        width = rnd.choice([3, 5, 14])
        rows += [("Fruits_a", f"s{sheet}", 0, [None, None, "x", None]), ("Fruits_a", f"s{sheet}", 3, [None, None, *(str(2000 + i // 12) if i % 12 == 0 else None for i in range(width - 2))])]
        rows.append(("Fruits_a", f"s{sheet}", 4, [None, None, *(f"p M{'abcdefghijkl'[i % 12]}" for i in range(width - 2))]))
        body = [(r, rnd.choice(["", "", None, "..Abra", "Bicol", "Cebu"]), rnd.choice(["Mango", "Guava", None]), [rnd.choice(["1.5", "2 Fruits", "..", None, "7.25"]) for _ in range(width - 2)]) for r in range(5, 60)]
        rows += [("Fruits_a", f"s{sheet}", r, [p, c, *v][: rnd.choice([width, width, 3])]) for r, p, c, v in body]
        place = None
        known = {r[2]: r[3] for r in rows if r[1] == f"s{sheet}"}
        for col in range(width - 2):
            for r, p, c, _ in body:
                place = (p or "").lstrip(".") or place
                if place and c:
                    cell = known[r][col + 2] if len(known[r]) > col + 2 else None
                    want.append((f"s{sheet}", r, col, place, c, 2000 + col // 12, "M" + "abcdefghijkl"[col % 12], {"1.5": 1.5, "2 Fruits": 2.0, "7.25": 7.25}.get(cell)))
    rnd.shuffle(rows)
    cells = spark.createDataFrame(rows, "file string, sheet string, row_idx int, cells array<string>")
    columns = ["sheet", "row", "col", "Geolocation", "Commodity", "Year", "Month", "Price"]
    listed = lambda df: sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert listed(R.sheets_to_prices(cells, impute=False)) == sorted(map(repr, want)) == listed(R.sheets_to_prices(cells, ["no such text"], impute=False))
    assert listed(R.sheets_to_prices(cells)) == listed(R.sheets_to_prices(cells, ["no such text"]))
    assert R.sheets_to_prices(cells.limit(0)).count() == 0


def test_chunks():
    parts = ["a" * 30, "b" * 30, "c" * 95, "d" * 10]
    out = C.split_text("\n\n".join(parts), 70)
    assert out == ["a" * 30 + "\n\n" + "b" * 30, "c" * 70, "c" * 25, "d" * 10]
    assert C.split_text("", 5) == [] and C.split_text(" ab ", 0) == ["ab"]
    assert all(len(x) <= 7 for x in C.split_text("one two three four\n\nfive", 7))


def test_chunk_records(spark):
    docs = spark.createDataFrame([("x", "a" * 150), ("y", "b" * 250)], "doc_id string, text string")
    got = sorted((r.chunk_doc_id, len(r.chunk_text)) for r in C.chunk_records(docs, F.col("doc_id"), 200, 100).collect())
    assert got == [("x", 150), ("y_chunk_0", 200)]


def test_chunks_are_cut_without_python(spark):
    """As ``split_text`` does, by built-in functions: texts used to go to Python workers 10,000 at a time."""
    rnd = random.Random(11)
    texts = [None, "", " \n", "x" * 50, "\x1c ab \x1f\n\n\u3000"]
    texts += ["".join(rnd.choices(["\n\n", "\n", " ", "\x1d", "word", "\u00f1\U0001f600", "a" * 25, "\u00a0"], k=rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for size in (0, 1, 7, 20, 60):
        cut = C.chunk_records(df, F.col("doc_id"), size, 0)
        assert "Python" not in cut._jdf.queryExecution().toString()
        got = {}
        for r in cut.collect():
            got.setdefault(int(r.doc_id), {})[r.chunk] = r.chunk_text
        assert [[x for _, x in sorted(got.get(i, {}).items())] for i in range(len(texts))] == [C.split_text(t, size) for t in texts]


def test_noise_and_pages(spark):
    pages = [("d", i, f"Annual Report\n{i}\nbody {i} text") for i in range(10)]
    df = spark.createDataFrame(pages, "doc string, page int, text string")
    noise = C.noise_lines(df)
    assert noise.first().noise == ["Annual Report"]
    assert C.clean_pages(df, noise).orderBy("page").first().text == "body 0 text"


def test_article_and_portal(spark):
    raw = "URL: https://x.y/a\nTitle: Rice Day\nDate: 2025-12-18\n\nSHARE\nMay 30, 2018\nRice Day\nThe body.\n\n\nMore.\nFor more information call"
    r = spark.createDataFrame([(raw,)], "t string").select(C.parse_article(F.col("t")).alias("a")).select("a.*", C.clean_article(F.col("a.body"), F.col("a.title")).alias("c")).first()
    assert (r.url, r.title, r.c) == ("https://x.y/a", "Rice Day", "The body.\n\nMore.")
    text = "HOME\nRice needs water.\nLOUD SHORT LINE\n3 years ago\nLeave a Reply\nIt grows.\nContact Us\nnever"
    got = spark.createDataFrame([(text,)], "t string").select(C.clean_portal(F.col("t"), 5)).first()[0]
    assert got == "Rice needs water.\nIt grows."


def test_validation(spark):
    good = {"text": "x" * 120, "input": "x" * 120, "source": "s", "doc_id": "a"}
    lines = [good, good | {"doc_id": 7}, good | {"input": "y"}, {k: v for k, v in good.items() if k != "doc_id"}, good, [1], good | {"page": "3", "doc_id": "p"}]
    rows = [("s", i + 1, json.dumps(x)) for i, x in enumerate(lines)] + [("s", 8, ""), ("s", 9, "{oops")]
    df = spark.createDataFrame(rows, "source_id string, line_no int, line string")
    bad = {r.line_no: r.errors for r in V.record_errors(df.filter("line != ''"), 100).collect()}
    assert bad[1] == [] and bad[5] == [] and "must be string" in bad[2][0] and "identical" in bad[3][0] and "missing" in bad[4][0]
    assert "expected JSON object" in bad[6][0] and "must be integer" in bad[7][0] and "invalid" in bad[9][0]
    registry = spark.createDataFrame([("s", "s.jsonl", 100), ("t", "t.jsonl", 100)], "source_id string, path string, min_chars int")
    report = {r.source_id: r for r in V.file_reports(df, registry, quality=True).collect()}
    assert report["s"].status == "failed" and report["s"].duplicates == 1 and report["s"].records == 8 and report["s"].empty_lines == 1
    assert report["t"].status == "skipped"
    assert report["s"].error_count == 6 and len(report["s"].errors) == 6 and report["s"].errors[0] == report["s"].first_error and report["s"].more_duplicates == 0
    many = spark.createDataFrame([("s", i, json.dumps([i])) for i in range(1, 71)], "source_id string, line_no int, line string")
    cut = V.file_reports(many, registry).filter("source_id = 's'").first()
    assert cut.error_count == 70 and [e.split(":")[0] for e in cut.errors] == [f"Line {i}" for i in range(1, V.SHOWN_ERRORS + 1)]


def test_split_jsonl(spark):
    rows = [("f", 1, '{"text": "a'), ("f", 2, ' b"}'), ("f", 3, ""), ("f", 4, '{"text": "c"}'), ("g", 1, '{"a": {'), ("g", 2, '{"b": 1}}')]
    df = spark.createDataFrame(rows[:4], "file string, line_no long, line string")
    got = [(r.start_line, r.end_line, json.loads(r.record)) for r in readers.read_split_jsonl(df).orderBy("start_line").collect()]
    assert got == [(1, 2, {"text": "ab"}), (4, 4, {"text": "c"})]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ñ", None), ("b", 'q"x\ny', "u")], "doc_id string, text string, url string")
    sinks.write_jsonl(rows, f"{tmp_path}/j")
    back = readers.read_jsonl(spark, f"{tmp_path}/j").select("doc_id", "text", "url")
    assert sorted(back.collect()) == sorted(rows.collect())
    sinks.write_csv(rows, f"{tmp_path}/c", ["doc_id", "text", "missing"])
    assert sorted(r.text for r in readers.read_strings(spark, f"{tmp_path}/c", ("doc_id", "text", "missing")).collect()) == ['q"x\ny', "ñ"]
    for day in ("2026-01-01", "2026-01-02"):
        sinks.write_snapshot(rows.withColumn("day", F.lit(day)), f"{tmp_path}/s", day)
    assert readers.read_snapshot(spark, f"{tmp_path}/s").first().day == "2026-01-02"
    assert readers.read_snapshot(spark, f"{tmp_path}/s", "backup").first().day == "2026-01-01"
    sources = [readers.CorpusSource("x", f"{tmp_path}/j"), readers.CorpusSource("y", f"{tmp_path}/none", required=False)]
    table, warnings = readers.read_corpora(spark, sources)
    assert table.count() == 2 and len(warnings) == 1
    with pytest.raises(ValueError):
        readers.read_corpora(spark, sources, "z")


def test_index_runs(spark):
    from fieldloom.functions.passages import price_passage

    raw = [("Abra", "Cereals", "Palay", "2023", m, p) for m, p in (("August", "24.0"), ("August", "25.0"), ("May", ".."))]
    rows = with_price_id(normalize_prices(spark.createDataFrame([(*r, i) for i, r in enumerate(raw)], PRICE + ", seq int")))
    records, knowledge, stats = sinks.index_rows(rows, price_passage(), "seq")
    assert tuple(stats.first()) == (3, 2, 2)
    assert sorted(r.price_php_per_kg or 0 for r in records.collect()) == [0, 25.0]
    assert all("Palay in Abra" in r.text for r in knowledge.collect())
    docs = spark.createDataFrame([("s", "a", "x"), ("s", "b", " "), ("t", None, "x")], "source_id string, doc_id string, text string")
    payloads, counts = sinks.index_corpora(docs)
    assert payloads.count() == 1 and {r.source_id: (r.read, r.indexed, r.skipped) for r in counts.collect()} == {"s": (2, 1, 1), "t": (1, 0, 1)}


def test_html(spark):
    html = (
        '<html><head><title> T &amp; t </title><script>x()</script></head><body><h1>H</h1><p>a <b>b</b></p><div id="detail_info"><table><tr><th>H1</th><th>H2</th></tr>'
        '<tr><td>1</td><td>2&nbsp;x</td></tr></table></div><a href="/news/p.pdf">l</a><a href="//o.example/q">m</a></body></html>'
    )
    p = H.parse_pages(spark.createDataFrame([("https://x.example/d/", html)], "url string, html string"), least=4)
    r = p.first()
    assert r.title == "T & t" and r.tables == [[["H1", "H2"], ["1", "2 x"]]] and r.text.split("\n")[:3] == ["H", "a", "b"]
    assert r.links == ["https://x.example/news/p.pdf", "https://o.example/q"] and r.focus == "H1\nH2\n1\n2\xa0x"
    assert {x.kind for x in H.page_links(p).collect()} == {"pdf", "other"}
    assert [x.col_2 for x in H.table_rows(p, 3).collect()] == ["", ""]
    y = '<div id="prov-12" value="Abra"></div><script>id="prov-9" value="no"</script><tr><th scope="row">Town&nbsp;A</th><td>1.0</td></tr>'
    df = spark.createDataFrame([(y,)], "html string")
    assert [tuple(x) for x in H.yield_rows(df).collect()] == [("Town A", 1.0)]
    assert [tuple(x) for x in H.provinces(df).collect()] == [(12, "Abra")]


def test_latest_documents(spark):
    rows = [
        (1, "irri", "A", "2024-05-01", 1.0), (2, "irri", "a ", "2024-05-01", 2.0), (3, "irri", "B", "2025-01-01", None),
        (4, "philrice", "A study", "2026-01-01", 9.0), (5, "irri", "C", None, 9.0),
    ]
    df = spark.createDataFrame(rows, "point_id long, source_id string, title string, date string, score double")
    ids = lambda kind, n=9: [r.point_id for r in C.latest_documents(df, F.to_date("date"), n, kind).collect()]
    assert ids(None) == [4, 3, 2] and ids("news") == [3, 2] and ids("papers") == [4] and ids(None, 1) == [4]


def test_words_holding(spark):
    words = spark.createDataFrame([("abcabc",), ("b",), ("xbcy",), ("ñu",)], "word string")
    terms = spark.createDataFrame([("b",), ("bca",), ("bc",), ("abcd",), ("ñu",)], "term string")
    want = sorted((w, t) for (w,) in words.collect() for (t,) in terms.collect() if t in w)
    assert sorted(map(tuple, S.words_holding(words, terms).collect())) == want


def test_search(spark):
    docs = spark.createDataFrame([(1, "palay price abra", [1.0, 0.0]), (2, "corn price", [0.0, 1.0]), (3, "palay palay", [0.7, 0.7])], "point_id long, text string, vector array<float>")
    q = spark.createDataFrame([(0, "palay price", [1.0, 0.1])], "query_id long, query string, vector array<float>")
    assert [r.point_id for r in S.token_overlap(q, docs, 2).orderBy("rank").collect()] == [1, 2]
    assert S.bm25(q, docs, 3).orderBy("rank").first().point_id == 1
    assert [r.point_id for r in S.dense(q, docs, 3).orderBy("rank").collect()] == [1, 3, 2]
    a, b = S.bm25(q, docs, 3), S.dense(q, docs, 3)
    fused = lambda *x: sorted((r.point_id, r.score) for r in S.reciprocal_rank_fusion(*x, limit=3).collect())
    assert fused(a, b) == fused(b, a)
    for fusion in ("rrf", "dbsf"):
        assert S.hybrid(q, docs, 1, F.col("point_id") < 3, fusion=fusion).first().point_id == 1


def test_messages(spark):
    texts = ["Ano ang average farmgate price ng palay sa Nueva Ecija 3 years ago?", "yield 2018 to 2015 and 2020", "balita", "hello", "peste last year"]
    got = G.annotate(spark.createDataFrame([(t,) for t in texts], "text string"), 2026).collect()
    first = got[0]
    assert (first.intent, first.language, first.place, first.commodity, first.preferred) == ("price_query", "taglish", "Nueva Ecija", "Palay", "summarize_prices")
    assert tuple(first.years) == (2023, 2023) and first.missing is None
    assert tuple(got[1].years) == (2015, 2018) and got[1].missing == "place"
    assert got[2].source_ids == ["philrice_news", "irri"] and got[3].intent == "unclear_query" and got[3].years is None
    assert (got[4].intent, got[4].missing, tuple(got[4].years)) == ("advisory_query", "crop", (2025, 2025))


def test_places_are_whole_words(spark):
    cases = {
        "from Davao del Norte to Abra": "Abra", "davao  del norte": None, "Tawi-Tawi!": "Tawi-Tawi", "abrax xabra abra_": None, "ni\u00f1aabra": None, "(CEBU)": "Cebu",
        "Samar, Northern Samar": "Northern Samar", "southern leyte": "Leyte", None: None, "": None, "leyte-southern": "Leyte",
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r.text: r.p for r in df.withColumn("p", G.place(F.col("text"))).collect()} == cases
    assert df.select(G.place(F.col("text"), ()).alias("p")).distinct().collect()[0].p is None


def test_places_in_long_texts_and_odd_lists(spark):
    """A text is looked at once: it used to be taken apart anew for each of its words."""
    text = "word, " * 30_000
    df = spark.createDataFrame([(text + "sa Samar, Abra.",), (text,), ("#1 new-york new-york-city a.b",), ("x#1 york",), ("\u00f1ew Yorkx",)], "text string")
    began = time.time()
    assert [r.p for r in df.select(G.place(F.col("text")).alias("p")).collect()] == ["Abra", None, None, None, None]
    assert time.time() - began < 60
    odd = ("A.b", "New-York-City", "new-york", "#1", "York")
    assert [r.p for r in df.select(G.place(F.col("text"), odd).alias("p")).collect()[2:]] == ["A.b", "#1", None]
    assert [r.p for r in df.select(G.place(F.col("text"), odd[::-1]).alias("p")).collect()[2:]] == ["York", "York", None]


def test_answers_over_ranges_of_years(spark):
    rnd = random.Random(9)
    prices = [(rnd.choice("AB"), rnd.choice(["Palay", "Corn"]), rnd.choice([1999, 2001, 2002, 2010, None]), rnd.choice([None, 1.25, 2.5, 7.75])) for _ in range(200)]
    asked = [(p, c, a, b) for p in ("A", "C", None) for c in ("Palay", None) for a, b in ((None, None), (2001, 2001), (1990, 2001), (2000, 2000), (2002, 2050), (2011, 2012), (2001, 2001))]
    rows = spark.createDataFrame(prices, "geolocation string, commodity string, year int, price_php_per_kg double")
    years = F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("year_min"), F.col("b").alias("year_max")))
    marked = spark.createDataFrame(asked, "place string, commodity string, a int, b int").select("place", "commodity", years.alias("years"), F.lit("summarize_prices").alias("preferred"))
    got = {(r.place, r.commodity, r.y0, r.y1): (r.priced_rows, r.avg_price) for r in G.answer_price_queries(marked, rows).collect()}
    assert set(got) == set(asked)
    for (p, c, a, b), (n, mean) in got.items():
        own = [x[3] for x in prices if x[3] is not None and x[2] is not None and p in (None, x[0]) and c in (None, x[1]) and (a is None or a <= x[2] <= b)]
        assert n == len(own) and (mean is None) == (not own) and (not own or abs(mean - sum(own) / n) <= 0.005001)
    yields = spark.createDataFrame([("Abra", 2019, 1, 3.0), ("Abra", 2020, 2, 5.0), ("Cebu", 2020, 1, 4.0)], "province string, year int, semester_code int, avg_yield_ton_ha double")
    wanted = spark.createDataFrame([("Abra", 2020, 2021), ("Abra", None, None), (None, 2020, 2020)], "place string, a int, b int").select("place", years.alias("years"), F.lit("summarize_yield").alias("preferred"))
    assert {(r.place, r.y0): (r.row_count, r.avg_yield) for r in G.answer_yield_queries(wanted, yields).collect()} == {("Abra", 2020): (1, 5.0), ("Abra", None): (2, 4.0), (None, 2020): (2, 4.5)}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    rows.write.parquet(f"{tmp_path}/in")
    run = lambda: ingest.ingest_upserts(ingest.stream_table(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/log", f"{tmp_path}/state", "k", "n")
    run()
    spark.createDataFrame([("b", 5)], "k string, n int").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(tuple(r) for r in ingest.current_rows(spark, f"{tmp_path}/log", "k", "n").collect()) == [("a", 2), ("b", 5)]


def test_first_seen_rows_restart_and_expire(spark, tmp_path):
    """Late rows are dropped, a known key comes back as new once its state has gone, and a restart goes on."""
    schema = "k string, n int, at timestamp"
    runs = ingest.Runs(spark, f"{tmp_path}/runs")

    def arrive(rows, fresh=False):
        made = spark.createDataFrame(rows, "k string, n int, t string").select("k", "n", F.to_timestamp("t").alias("at"))
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.keep_first_seen(stream, runs, "k", "at", "1 hour", fresh)
        return sorted((r.k, r.n) for r in runs.read().collect())

    assert arrive([("a", 1, "2026-01-01 10:00:00"), ("b", 1, "2026-01-01 10:10:00")]) == [("a", 1), ("b", 1)]
    arrive([("a", 2, "2026-01-01 10:20:00"), ("c", 1, "2026-01-01 10:30:00")])
    assert ("c", 1) in {(r.k, r.n) for r in runs.read().collect()} and ("a", 2) not in {(r.k, r.n) for r in runs.read().collect()}
    arrive([("d", 1, "2026-01-01 15:00:00")])  # the watermark goes to 14:00
    arrive([("late", 1, "2026-01-01 13:00:00"), ("a", 3, "2026-01-01 15:10:00"), ("d", 2, "2026-01-01 15:20:00")])
    got = {(r.k, r.n) for r in runs.read().collect()}
    assert ("late", 1) not in got and ("a", 3) in got and ("d", 2) not in got
    again = arrive([("z", 1, "2026-01-01 15:30:00")], fresh=True)
    assert ("a", 1) in again and runs.read(1).count() == len(got) and runs.current().endswith("run-2")


def test_links_error_pages_and_original_urls(spark):
    from fieldloom.functions.text import source_link

    rows = [("pinoyrice", "A title & more*~", "f.pdf", None, " "), ("Philrice", " ", "f g.pdf", None, None), ("irri", "t", None, None, None), ("irri", "t", None, "", "https://x/y"), ("philrice", None, "", None, None), ("philrice", "t", None, "https://a", "https://b")]
    df = spark.createDataFrame(rows, "s string, t string, f string, u string, v string")
    got = [r[0] for r in df.select(source_link(*(F.col(c) for c in "stfuv"))).collect()]
    assert got == ["https://www.pinoyrice.com/?s=A+title+%26+more%2A~", "https://www.philrice.gov.ph/?s=f+g.pdf", None, "https://x/y", None, "https://a"]
    pages = spark.createDataFrame([("404 - gone", "x"), ("Fine", "The page was Not Found here"), ("Rice 4040", "y" * 801 + " 404"), (None, None)], "title string, text string")
    assert [r[0] for r in pages.select(H.is_error_page(F.col("title"), F.col("text"))).collect()] == [True, True, False, False]
    parsed = spark.createDataFrame([("https://p.example/dataproducts/", "T", "w " * 50), ("https://p.example/a", "T", "w " * 50), ("https://p.example/b", "T", "short")], "url string, title string, focus string")
    assert sorted((r.url, r.original_url) for r in H.page_records(parsed, host="p.example").collect()) == [("https://p.example/a", None), ("https://p.example/wp-dynamicreports", "https://p.example/dataproducts/")]


def test_text_files_and_sheets_of_a_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a b.txt").write_text("x" * 90 + "\n\n" + "y" * 90)
    (tmp_path / "t" / "blank.txt").write_text("  \n")
    got = readers.read_text_records(spark, f"{tmp_path}/t", "files", preprocess=F.upper, size=100, least=50).collect()
    assert sorted((r.doc_id, r.text, r.source, r.filename) for r in got) == [("a_b_chunk_0", "X" * 90, "files", "a b.txt"), ("a_b_chunk_1", "Y" * 90, "files", "a b.txt")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "Cereals_x__Palay.csv").write_text('Title,,\n\n,,2020,\r\n,,January,February\n"..Abra, north",Palay,10.5,20.25\n,Palay,..,"30"\n')
    cells = readers.read_sheets(spark, f"{tmp_path}/s", width=8)
    assert [(r.file, r.sheet, r.row_idx, r.cells) for r in cells.orderBy("row_idx").collect()][2:5] == [("Cereals_x", "Palay", 3, [None, None, "2020"]), ("Cereals_x", "Palay", 4, [None, None, "January", "February"]), ("Cereals_x", "Palay", 5, ["..Abra, north", "Palay", "10.5", "20.25"])]
    prices = R.sheets_to_prices(cells).orderBy("col", "row").collect()
    assert [(r.Geolocation, r.Year, r.Month, r.Price, r["Commodity Type"]) for r in prices] == [("Abra, north", 2020, "January", 10.5, "Cereals"), ("Abra, north", 2020, "January", 20.25, "Cereals"), ("Abra, north", 2020, "February", 20.25, "Cereals"), ("Abra, north", 2020, "February", 30.0, "Cereals")]
