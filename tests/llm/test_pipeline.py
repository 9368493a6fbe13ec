import os
import random

import pytest

import corpus_pipeline
from fieldloom.llm import packing, quality, repeats

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_against_stages_by_brute_force(spark):
    """The run's sequences against the stages' results, each recomputed from its own input."""
    from tests.llm.test_neardup import brute as brute_groups
    from tests.llm.test_repeats import brute as brute_repeats

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.with_quality(docs).filter("kept").select("doc_id", "text").collect()
    groups = {d: c for d, _, c in brute_groups([(r.doc_id, r.text) for r in kept], 5, 80)}
    left = sorted((r.doc_id, r.text) for r in kept if groups[r.doc_id] == r.doc_id)
    cut = []
    for (d, t), spans in zip(left, brute_repeats(left, 240), strict=True):
        long = [{"s": a, "e": b} for a, b in spans if len(t.encode()[a:b].split()) > 50]
        text = repeats.kept_bytes(t, long).decode("utf-8", "ignore")
        if text.strip(" "):
            cut.append((d, text))
    counts = packing.with_token_counts(spark.createDataFrame(cut, "doc_id long, text string")).collect()
    want = {r.doc_id: r.n_tokens for r in counts}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == want


def test_repeated_rows_and_null_ids_leave_one_document(spark):
    """Each group keeps one row by brute force on the texts, and the next stage loses none of them."""
    from tests.llm.test_neardup import brute as brute_groups

    rnd = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(100)) for _ in range(5))
    near = b.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, a), (1, a), (None, a), (None, b), (None, b), (7, b), (9, near), (None, c), (None, c), (3, d), (3, e), (4, e), (5, d), (None, None), (6, "")]
    table = [(i, t, "en", f"s{n}", len(t or "")) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    deduped = corpus_pipeline.near_dedup(spark, df, "")
    assert deduped.columns == corpus_pipeline.COLUMNS
    got = [(r.doc_id, r.text) for r in deduped.collect()]
    group = {}
    for n, _, least in brute_groups([(n, t) for n, (_, t) in enumerate(rows)], 5, 80):
        group.setdefault(least, []).append(n)
    last = lambda i: 10**9 if i is None else i
    want = [min((rows[n] for n in ns), key=lambda r: last(r[0])) for ns in group.values()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, deduped, "").collect()]
    assert sorted(left, key=str) == sorted(((1, a), (7, b), (None, c), (3, d), (3, e)), key=str)


def test_passages_of_over_50_words_are_cut_and_shorter_ones_stay(spark):
    rnd = random.Random(9)
    words = lambda n: " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(10**4):04}" for _ in range(n))
    long, short = words(51), words(49)
    heads = [words(40) for _ in range(6)]
    texts = [f"{heads[0]} {long} {words(30)}", f"{heads[1]} {long}", f"{heads[2]} {short} {words(30)}", f"{heads[3]} {short}", f"{heads[4]} {words(200)}", None, ""]
    table = [(i, t, "en", "s", 0, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, repeats long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert [got[i] == texts[i] for i in range(5)] == [False, False, True, True, True]
    assert all(got[i].startswith(heads[i]) and long[6:-6] not in got[i] for i in (0, 1))


def test_stages_on_odd_tables(spark):
    """Nulls in every column, an empty table and a clashing extra column: no stage fails on them."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text long, repeats long, pieces string"
    odd = spark.createDataFrame([(None,) * 8, (None, "", "", "", 0, 1, 1, ""), (3, "a b " * 40, None, None, None, None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, "").collect()
        assert stage(spark, odd.limit(0), "").count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "repeated_passages", "packing"]
