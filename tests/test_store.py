"""Versioned tables, the stored index, phrases in texts, and free names."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import index as I
from fieldloom.operators import merge as M
from fieldloom.operators import search as S
from fieldloom.sources.store import SearchStore, Store, index_run


def rows_of(df):
    return sorted(map(tuple, df.collect())) if df is not None else []


def test_versions_upserts_and_pruning(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", "k", parts=4)
    assert store.read() is None and store.versions() == []
    make = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    store.upsert(make([(i, "a") for i in range(20)]))
    store.upsert(make([(3, "b"), (30, "b")]))
    store.upsert(make([(3, "c")]))
    want = {i: "a" for i in range(20)} | {30: "b", 3: "c"}
    assert dict(rows_of(store.read())) == want and dict(rows_of(store.read(1))) == {i: "a" for i in range(20)}
    before, after = store.manifest(2), store.manifest(3)
    assert sum(before[p] != after[p] for p in after) == 1  # one key touches one part
    assert store.prune(keep=2) == [1] and store.versions() == [2, 3]
    assert dict(rows_of(store.read())) == want and dict(rows_of(store.read(2)))[3] == "b"
    folders = {f.rpartition("/")[0] for v in store.versions() for f in store.manifest(v).values()}
    assert {f"data/{n}" for n in store._names("data")} == folders
    assert store.prune(keep=1) == [2] and dict(rows_of(store.read())) == want


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/s", "k", parts=2)
    store.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    new = spark.createDataFrame([(1, "z"), (2, "z")], "k long, v string")
    with monkeypatch.context() as m:
        m.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.upsert(new)
    assert rows_of(store.read()) == [(1, "a")] and store.versions() == [1]
    with monkeypatch.context() as m:  # another run takes the version first
        m.setattr(Store, "versions", lambda self: [])
        with pytest.raises(FileExistsError):
            store.commit(new)
    assert rows_of(store.read()) == [(1, "a")]
    store.upsert(new)
    assert rows_of(store.read()) == [(1, "z"), (2, "z")]
    store.prune(1)
    assert len(store._names("data")) == 1  # what the dead runs wrote is gone


def test_index_runs(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", "point_id", parts=2)
    records = spark.createDataFrame([("a", "1", "x"), ("a", None, "x"), ("b", "2", "y"), ("b", "2", "y2")], "source_id string, point_id string, text string")
    expected = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "source_id string, required boolean")
    dry = {r.source_id: r for r in index_run(store, records, expected, "2026-01-01", dry=True).collect()}
    assert (dry["a"].read, dry["a"].indexed, dry["a"].skipped, dry["a"].missing) == (2, 1, 1, False) and store.versions() == []
    assert dry["c"].missing and dry["c"].warning.startswith("required") and dry["d"].warning.startswith("optional") and dry["a"].warning is None
    index_run(store, records, expected, "2026-01-01")
    index_run(store, records.filter("point_id = '1'"), expected, "2026-01-02")
    assert {r.point_id: r.indexed_at for r in store.read().collect()} == {"1": "2026-01-02", "2": "2026-01-01"}
    index_run(store, records.filter("point_id = '1'"), expected, "2026-01-03", recreate=True)
    assert [r.point_id for r in store.read().collect()] == ["1"] and store.read(2).count() == 2


def texts(rnd, n):
    words = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(4000)]
    return [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(n)]


def test_stored_search_is_bm25_and_reads_few_blocks(spark, tmp_path):
    rnd = random.Random(5)
    docs = texts(rnd, 600) + [(1000 + i, f"rare{i} rare{i} w1") for i in range(30)]
    df = spark.createDataFrame(docs, "point_id long, text string")
    queries = spark.createDataFrame([(i, f"rare{i} w1 w2") for i in range(30)] + [(100, "w3 w1 w250"), (101, "nowhere"), (102, ""), (103, None)], "query_id long, query string")
    store = SearchStore(spark, f"{tmp_path}/s", parts=48)
    old = df.withColumn("text", F.when(F.col("point_id") % 3 == 0, "old text w1").otherwise(F.col("text")))
    store.upsert(old)
    store.upsert(df.filter("point_id % 3 = 0 OR point_id > 1020"))
    want = rows_of(S.bm25(queries, df, 3).select("query_id", "rank", "point_id", "score"))
    hits, read = I.search(store.index.read(), queries, 3)
    assert rows_of(hits.select("query_id", "rank", "point_id", "score")) == want and len(want) >= 93
    rare = queries.filter("query_id < 30")
    best, read = I.search(store.index.read(), rare, 1)
    assert rows_of(best.select("query_id", "point_id", "score")) == rows_of(S.bm25(rare, df, 1).select("query_id", "point_id", "score"))
    terms = rare.select("query_id", F.explode(S.tokens(F.col("query"))).alias("term"))
    every = terms.join(store.index.read(), "term").select("query_id", "block").distinct().count()
    assert 30 <= read.count() == read.select("query_id", "block").distinct().count() < every / 10  # of some 48 blocks a query
    found = store.search(queries, 3, F.col("point_id") % 2 == 0)
    own = S.bm25(queries, df, 10_000).filter("point_id % 2 = 0")
    assert rows_of(found.select("query_id", "rank", "point_id")) == rows_of(S.ranked(own.drop("rank"), 3).select("query_id", "rank", "point_id"))
    assert store.search(queries, 3, min_score=1000.0).count() == 0


def test_shaped_hits(spark):
    hits = spark.createDataFrame([(1, "2020", "1.5", None), (2, None, "1", "x"), (3, "soon", "1", "x"), (4, "7", "2", "y")], "point_id long, year string, v string, note string")
    assert rows_of(S.shaped(hits, {"year": "int", "v": "double"}, ("note",))) == [(1, 2020, 1.5, ""), (4, 7, 2.0, "y")]


def test_phrases_in_texts(spark):
    rnd = random.Random(12)
    docs = [(i, " ".join(rnd.choices(["a", "bb", "ccc", "dd", "rice", "x.y"], k=rnd.randint(0, 40))).replace("dd dd", "dd\n dd")) for i in range(120)] + [(500, None), (501, "bb"), (0, "bb a")]
    phrases = []
    for i in range(40):
        t = rnd.choice(docs[:120])[1]
        a = rnd.randint(0, max(0, len(t) - 1))
        phrases.append((i, t[a : a + rnd.choice([1, 3, 8, 20, 40])]))
    phrases += [(90, None), (91, " "), (92, "not there at all of it"), (93, "ice ri"), (94, "bb")]
    got = S.texts_holding(spark.createDataFrame(phrases, "query_id long, query string"), spark.createDataFrame(docs, "point_id long, text string"))
    want = sorted((q, d) for q, p in phrases for d, t in docs if p is not None and p.strip() and t is not None and p in t)
    assert sorted((r.query_id, r.point_id) for r in got.collect()) == want and len(want) > 200
    assert S.texts_holding(spark.createDataFrame(phrases, "query_id long, query string").limit(0), got.select("point_id", "text")).count() == 0


def test_free_names(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["x", "x", "x", "x_2", "y", "y_07", "z_3", "é f"])) for i in range(200)]
    there = ["x", "x_2", "x_3", "x_7", "x_7", "x_100", "x_02", "y_2", "z_3_1", "z_3_2", "q", "x_9_9"]
    got = M.unique_names(spark.createDataFrame(rows, "n int, base string"), "base", "n", spark.createDataFrame([(t,) for t in there], "base string")).collect()
    bases, taken, want = {b for _, b in rows}, set(there), {}
    for n, b in rows:
        k = 1
        while (name := b if k == 1 else f"{b}_{k}") in taken or k > 1 and name in bases:
            k += 1
        taken.add(name)
        want[n] = name
    assert {r.n: r.unique_name for r in got} == want and len(set(want.values())) == len(want) and not set(want.values()) & set(there)
    assert got[0].asDict().keys() == {"n", "base", "unique_name"}
