import random
from collections import Counter

import numpy as np

from fieldloom.llm import quality as Q
from fieldloom.llm.textkit import WordHashes


def brute_stats(text):
    t = text or ""
    b = t.encode()
    words = b.split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_stats():
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a\x1cb é ü", "x" * 5]
    for _ in range(60):
        texts.append("".join(rnd.choice(["a ", "b ", "c\n", "é# ", "\n", "a b c d e f g h ", "<|> "]) for _ in range(rnd.randint(0, 80))))
    cache = WordHashes()
    assert [Q.text_stats(t, cache) for t in texts] == [brute_stats(t) for t in texts]


def test_chi_squared():
    assert abs(Q._chi2_cdf(11.0705, 5) - 0.95) < 1e-4 and abs(Q._chi2_quantile(0.975, 5) - 12.8325) < 1e-3


def text(rnd, n, junk=False):
    w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n)]
    return " ".join(x + "&&&" for x in w) if junk else " ".join(w)


def test_outliers_go_and_clean_texts_stay(spark):
    rnd = random.Random(4)
    rows = [(i, text(rnd, rnd.randint(30, 400), i % 10 == 0), "en", "big" if i % 2 else f"s{i % 6}") for i in range(900)]
    rows += [(1000, None, None, None), (1001, "", "en", "big"), (1002, text(rnd, 50), "xx", None), (1002, text(rnd, 50), "xx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_words", "true AS kept")
    got = Q.with_quality(df).collect()
    assert len(got) == len(rows)
    for r in got:
        junk = r.doc_id < 900 and r.doc_id % 10 == 0
        assert r.base_failed == (r.text is None or r.text == "") and r.kept == (not junk and not r.base_failed), r.doc_id


def test_a_third_of_copies_of_one_junk_text(spark):
    """A source of which a third is one junk text again and again: copies and other junk go, the rest stays."""
    rnd = random.Random(7)
    rows = [(i, text(rnd, rnd.randint(30, 400), i % 20 == 0), "en", "s") for i in range(400)]
    copy = text(rnd, 300, junk=True)
    rows += [(1000 + i, copy, "en", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for r in Q.with_quality(df).select("doc_id", "kept").collect():
        assert r.kept == (r.doc_id < 1000 and r.doc_id % 20 != 0), r.doc_id


def test_a_small_source_is_judged_by_its_own_rows(spark):
    """Texts that are usual in a source of 60 rows stay, however rare in the language; its own outlier goes."""
    rnd = random.Random(8)
    rows = [(i, text(rnd, rnd.randint(30, 400)), "en", "plain") for i in range(300)]
    rows += [(1000 + i, text(rnd, rnd.randint(30, 400), i < 59), "en", "small") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in Q.with_quality(df).filter("not kept").collect()} == {1059}


def test_estimates_are_the_concentration_steps(spark):
    """The fit of one group against the same steps in numpy."""
    rnd = np.random.default_rng(1)
    n = 800
    words = rnd.integers(30, 500, n)
    stats = [(int(i), "en", "s", int(w), int(w * rnd.uniform(4, 7)), int(rnd.poisson(1) + (i % 9 == 0) * w), 0, 0) for i, w in enumerate(words)]
    df = spark.createDataFrame(stats, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in Q.STATS))
    fit = {r.key: r for r in Q.fit_outliers(df, share=0.75, steps=6).collect()}
    s = np.array([x[3:] for x in stats], float)
    base = s[:, 0] + Q.PRIOR_WORDS
    x = np.stack([np.log(base), (s[:, 1] + Q.PRIOR_CHARS) / base, np.log1p(100 * s[:, 2] / base), np.log1p(100 * s[:, 3] / base), s[:, 4] / base], 1)
    floor = np.diag(np.square(Q.LEAST_SD))
    median = lambda v: (np.floor(np.sort(v, axis=0)[(n + 1) // 2 - 1] * 500) + 0.5) / 500
    m = median(x)
    inv = np.diag(1 / ((1.4826 * median(np.abs(x - m))) ** 2 + np.square(Q.LEAST_SD)))
    d2 = lambda m, inv: np.einsum("ni,ij,nj->n", x - m, inv, x - m)

    def step(m, inv):
        b = np.floor(np.log1p(d2(m, inv)) * 200)
        near = x[b <= np.sort(b)[int(np.ceil(0.75 * n)) - 1]]
        cov = np.cov(near.T, bias=True) * 0.75 / Q._chi2_cdf(Q._chi2_quantile(0.75, 5), 7) + floor
        return near.mean(axis=0), np.linalg.inv(cov), np.round(np.linalg.slogdet(cov)[1], 9)

    rows = spark.createDataFrame([("k", *map(float, v)) for v in x], "key string, " + ", ".join(f"{c} double" for c in Q.DIMS))
    begin = [(0, m, inv)]
    for r in sorted(Q._elemental_starts(rows, Q.STARTS).collect(), key=lambda r: r.start):
        full = np.array([[r[f"q{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
        begin.append((r.start, np.array([r[f"m{i}"] for i in range(5)]), full))
    assert len(begin) == 1 + Q.STARTS
    ends = []
    for s0, m, inv in begin:
        for _ in range(2):
            m, inv, det = step(m, inv)
        ends.append((det, s0, m, inv))
    _, _, m, inv = min(ends, key=lambda e: e[:2])
    for _ in range(4):
        m, inv, _ = step(m, inv)
    m = x[d2(m, inv) <= Q._chi2_quantile(0.975, 5)].mean(axis=0)
    got = fit["s\t=en\t=s"]
    assert np.allclose([got[f"m{i}"] for i in range(5)], m, atol=1e-6)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.with_quality(df).count() == 0
