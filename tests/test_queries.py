"""Every registered query against its SQL on the smallest tables, where they are at hand."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["price_summary_by_place_year", "yield_summary", "price_keep_last", "price_passages", "work_grid_pending", "page_ids", "search_bm25", "message_rules", "stream_upserts", "message_price_answers", "search_token_overlap", "latest_listing", "latest_pages", "corpus_reports", "job_validation", "sheet_reshape", "search_evaluation", "search_price_passages", "search_corpus_passages", "message_yield_answers", "message_places", "price_records", "unique_file_names", "stream_first_events"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return ""
        if isinstance(v, float):
            return str(round(v, 6)) if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["corpus_reports", "job_validation"])
def test_reports_of_odd_documents(spark, tmp_path, name):
    """A source for each: blank and unknown texts, other white space at their ends, a doc_id that stands twice
    or is null, and a null source."""
    import duckdb

    long, edge = "x" * 150, "y" * 99
    texts = {
        "src0": ["", long], "src1": [" \n", "\t\r"], "src2": [None, long], "src3": [edge + "\xa0", "\u2003" + edge, edge + "\n"], "src4": ["\xa0", "\x0b"],
        "src5": [long] * 4, "src6": [long, long], "src7": [long, "short"], None: [long, "short", long], "src8": ["\\" * 101, '"{[' * 34, "😀" * 99],
    }
    ids = {"src5": [13, 13, 1, 1], "src6": [5, 5], "src7": [None, None], None: [130, 131, 97]}
    docs = [(i, t, s) for k, (s, x) in enumerate(texts.items()) for i, t in zip(ids.get(s, range(1002 + 10 * k, 1009 + 10 * k)), x)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_row_at_a_time_python(spark):
    for name in ("price_summary_by_place_year", "yield_summary", "price_merge_resumed", "search_bm25", "message_rules"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan
    for name in ("message_price_answers", "search_token_overlap", "search_dense", "search_evaluation"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey" in plan and "l_comment" not in plan
