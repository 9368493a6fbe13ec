"""Lexical search scores where the passages are read."""

import math
import random
import re

from fieldloom.operators import search as S


def brute(queries, docs, limit):
    words = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in docs if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    out, plain = [], []
    df = lambda t: sum(t in w for w in words.values())
    for q, text in queries:
        terms = set(re.findall(r"[a-z0-9]+", (text or "").lower()))
        idf = {t: math.log(1 + (len(docs) - df(t) + 0.5) / (df(t) + 0.5)) for t in terms}
        scores, counts = {}, {}
        for i, w in words.items():
            tf = {t: w.count(t) for t in terms if t in w}
            if tf:
                scores[i] = round(sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in tf.items()), 9)
                counts[i] = float(sum(tf.values()))
        for found, into in ((scores, out), (counts, plain)):
            into += [(q, i, s) for i, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:limit]]
    return sorted(out), sorted(plain)


def test_lexical_is_brute_force_and_shuffles_best_rows_only(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, "the " + " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(400)] + [(900 + i, "the w1 w2 w3") for i in range(30)] + [(999, None), (998, "")]
    queries = [(i, "The " + " ".join(rnd.choices(words + ["none"], k=4))) for i in range(30)] + [(70, ""), (71, None), (72, "none")]
    frames = spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(docs, "point_id long, text string")
    whole = S.query_blocks
    for most in (2000, 7):
        monkeypatch.setattr(S, "query_blocks", lambda q, most=most: whole(q, most))
        monkeypatch.setattr(S, "SLICE", 50)
        legs = S.lexical(*frames, 5)
        got = [sorted((r.query_id, r.point_id, r.score) for r in leg.collect()) for leg in legs]
        for g, want in zip(got, brute(queries, docs, 5), strict=True):
            assert [x[:2] for x in g] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(g, want, strict=True))
        plan = legs[0]._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "point_id" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan))  # a common word makes no row a pair
    assert S.bm25(frames[0].filter("query_id > 69"), frames[1], 5).count() == 0


def test_stored_index_names_a_passage_once_and_ties_go_by_id(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from fieldloom.operators import index as I
    from fieldloom.sources.store import SearchStore

    monkeypatch.setattr(I, "BLOCK_BITS", 4)  # many blocks, all with the same bounds
    docs = [(f"p{i:04d}-{i % 3}", "rice price of the year" if i % 2 else f"price of n{i}", i) for i in range(300)] + [("z", None, 0)]
    df = spark.createDataFrame(docs, "point_id string, text string, n int")
    queries = spark.createDataFrame([(1, "rice price"), (2, "n40 of")], "query_id int, query string")
    store = SearchStore(spark, f"{tmp_path}/s", parts=3)
    store.upsert(df)
    store.upsert(df.filter("n % 5 = 0"))
    ids = store.index.read().select(F.explode("ids")).collect()
    assert len(ids) == 301 == len(set(ids))
    got = [(r.query_id, r.point_id, r.score) for r in store.search(queries, 7, F.col("n") > 20).orderBy("query_id", "rank").collect()]
    want = S.ranked(S.bm25(queries, df, 400).drop("rank").join(df.filter("n > 20").select("point_id"), "point_id", "left_semi"), 7)
    assert got == [(r.query_id, r.point_id, r.score) for r in want.orderBy("query_id", "rank").collect()] and len(got) == 14


def test_token_overlap_is_brute_force_and_shuffles_best_rows_only(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["a", "an", "rice", "price", "prices", "Ñame", "x#y", "ice"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 6)))) for i in range(300)] + [(900, None), (901, " \n")]
    queries = [(i, " ".join(rnd.choices([*words, "none", "ric"], k=rnd.randint(1, 5)))) for i in range(30)] + [(70, ""), (71, None), (72, "none")]
    frames = spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(docs, "point_id long, text string")
    monkeypatch.setattr(S, "SLICE", 50)
    whole = S.query_blocks
    for most, least in ((2000, 0.0), (7, 1 / 3), (2000, 2 / 3)):
        monkeypatch.setattr(S, "query_blocks", lambda q, most=most: whole(q, most))
        want = []
        for q, text in queries:
            terms = {*(text or "").lower().split()}
            scores = [(-m / len(terms), i) for i, t in docs if terms and (m := sum(x in (t or "").lower() for x in terms)) and m / len(terms) >= least]
            want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scores)[:5])]
        hits = S.token_overlap(*frames, 5, least)
        assert sorted((r.query_id, r.point_id, r.score, r.rank) for r in hits.collect()) == want
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "point_id" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan))  # neither words nor pairs are shuffled
    assert S.token_overlap(frames[0].filter("query_id = 70"), frames[1], 5).count() == 0
