"""Few keys of very many rows don't meet in one task."""

import re

from fieldloom.operators import merge as M


def test_rows_of_an_updated_url_are_dropped_where_they_are_read(spark):
    cols = ["Geolocation", "Commodity", "Year", "Month", "Source URL", "seq", "Price"]
    old = spark.createDataFrame([(f"g{i}", "c", "1997", "May", f"u{i % 5}", i, i) for i in range(50)], cols)
    new = spark.createDataFrame([("g1", "c", "1997", "May", "u1", 3, -1), ("g2", "c", "1997", "May", "u1", 3, -2)], cols)
    merged = M.merge_prices(old, new, new.select("Source URL"), resume=True)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(Source URL|_url)", plan)
    got = {r.Geolocation: r.Price for r in merged.collect()}
    assert got == {f"g{i}": i for i in range(50) if i % 5 != 1} | {"g1": -1, "g2": -2}
