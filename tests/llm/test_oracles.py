import os

import duckdb
import pytest

from fieldloom.llm import queries

SF = "/root/testdata/sf0.001"


def split(row):
    """The row's exact values, as sortable text, and its floating-point ones, which differ in the last bits."""
    return repr([v for v in row if not isinstance(v, float)]), [v for v in row if isinstance(v, float)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    got, wanted = sorted(map(split, df.select(*columns).collect())), sorted(map(split, want.fetchall()))
    assert [x for x, _ in got] == [x for x, _ in wanted]
    for (_, x), (_, y) in zip(got, wanted, strict=True):
        assert x == pytest.approx(y, rel=1e-11, abs=1e-11)
