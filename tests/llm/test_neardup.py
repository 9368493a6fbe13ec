import random

import pytest

from fieldloom.llm import neardup
from fieldloom.llm.components import connected_components


def sets_of(text, k):
    w = bytes((text or "").encode().lower()).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(d, best.get(find(i), d))
    return sorted((d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(30, 120))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 5, 20])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    return rows + [(1000, ""), (1001, None), (1002, "a b"), (1003, "A  b"), (1004, "x"), (1005, rows[0][1].upper()), (1006, "\n\t ")]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_are_those_of_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    if bucket == 3:
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    rows = corpus(bucket)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS label", "2 AS block")
    got = neardup.near_duplicates(df, ngram=4, percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (5, "a b c d")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (5, 1, False)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    both_null = spark.createDataFrame([(None, "q w e r t"), (None, "q w e r t")], "doc_id long, text string")
    assert [r.component_id for r in neardup.near_duplicates(both_null).collect()] == [None, None]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (100, 101)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
