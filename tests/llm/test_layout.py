import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import packing, sharding, vptree


def test_boundaries_waste_the_least():
    rnd = random.Random(1)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 8)))
        counts = [rnd.randint(1, 20) for _ in lengths]
        k = rnd.randint(1, 4)
        got = packing.best_boundaries(np.array(lengths), np.array(counts), k)

        def waste(ends):
            return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts, strict=True))

        best = min(waste((*c, lengths[-1])) for r in range(k) for c in combinations(lengths[:-1], r))
        assert got[-1] == lengths[-1] and len(got) <= k and waste(got) == best


def test_batches_keep_every_token(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 300)) for i in range(500)] + [(7, 40), (7, 40), (None, 5), (600, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=4, max_tokens=100, budget=400).collect()
    want = Counter()
    for d, n in rows:
        want[d] += n or 0
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n_tokens
        assert 0 < r.n_tokens <= r.padded_to <= 100
    assert {k: v for k, v in want.items() if v} == dict(have)
    batches = Counter((r.bucket, r.batch) for r in got)
    slots = {(r.bucket, r.batch, r.slot) for r in got}
    assert len(slots) == len(got) and len({r.padded_to for r in got}) <= 4
    for (b, k), n in batches.items():
        size = max(1, 400 // next(r.padded_to for r in got if r.bucket == b))
        last = max(x for y, x in batches if y == b)
        assert n == size if k < last else 0 < n <= size
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "rice rice"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 AS bucket")
    assert {r.doc_id: r.n_tokens for r in packing.pack_documents(df).collect()} == {1: 3, 2: 1, 3: 1}


@pytest.mark.parametrize("n", [0, 5, 501])
def test_shards_match_the_mixture(spark, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["é", "x y", None]), rnd.choice(["big"] * 6 + ["a", "b", None])) for i in range(n)] + [(0, "x", "a")] * (n > 5) * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS shard", "2 AS _rank")
    got = sharding.interleave(df, shards=24).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got)) == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    per = Counter(r.shard for r in got)
    if n:
        sizes = [per[s] for s in range(24)]
        assert max(sizes) - min(sizes) <= 1
        mix = Counter(r.source for r in got)
        for s in range(24):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
            own = Counter(r.source for r in got if r.shard == s)
            assert all(abs(own[k] - v * per[s] / len(got)) <= 2 for k, v in mix.items())


@pytest.mark.parametrize("n,shards", [(0, 3), (2, 5), (400, 24), (401, 7)])
def test_places_are_those_of_brute_force(spark, n, shards):
    """Every row's shard and slot, from the same seeded draws, in plain Python."""
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["é", "x y", "z" * 40, None]), rnd.choice(["big"] * 6 + ["a", "b", None])) for i in range(n)] + [(0, "x", "a")] * (n > 5) * 3 + [(None, "q", "big")] * (n > 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.unhex(F.lit(""))))
    drawn = df.select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), crc.alias("crc"), F.xxhash64(F.lit(11), "doc_id", crc).alias("draw"), F.xxhash64(F.lit(11), "source").alias("of")).collect()
    low = lambda x: (x is not None, x or 0)
    by_source = {}
    for r in drawn:
        by_source.setdefault(r.source, []).append(r)
    placed = []
    for own in by_source.values():
        own.sort(key=lambda r: (r.draw, low(r.doc_id), r.crc))
        placed += [((2 * k + 1) / (2 * len(own)), r.of, r.draw, low(r.doc_id), r.crc, r) for k, r in enumerate(own)]
    placed.sort(key=lambda x: x[:5])
    want = []
    for place, x in enumerate(placed):
        shard = place * shards // len(placed)
        want.append((x[5].doc_id, x[5].bytes + 8, x[5].crc, shard, place - (shard * len(placed) + shards - 1) // shards))
    got = sharding.interleave(df, shards=shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6)).astype(np.float32)
    v[n // 2 : n // 2 + n // 5] = v[0]  # a third of a tie
    return v


@pytest.mark.parametrize("shard_rows", [4096, 60])
def test_neighbours_are_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vptree, "LEAF", 8)
    v = vectors(400)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(1000, None), (1050, [0.0] * 6), (1100, [float("nan")] * 6), (1150, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1200, [1.0, 2.0]), (None, [1.0] * 6), (1250, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS shard")
    got = {}
    for r in vptree.nearest(df, shard_rows=shard_rows, block_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = v.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    for q in range(0, 400, 50):
        s = (x * x[q]).sum(axis=1) / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert [i for i, _ in got[q]] == order and np.allclose([c for _, c in got[q]], s[order], atol=1e-12)
    assert set(got) == set(range(0, 400, 50))
    assert vptree.nearest(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_candidates(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.99, 0.1]), (1, [0.0, 1.0]), (100, [1e300, 1e300]), (2, [1e-310, 0.0])]
    got = {}
    for r in vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 4)))
    assert sorted(got[50]) == [(1, 2, 0.9949), (1, 2, 1.0), (2, 50, 0.9949), (2, 50, 0.9949)]
    assert got[100] == [(1, 50, 0.7746), (2, 1, 0.7071)] and set(got) == {50, 100}


def test_recall_falls_slowly_with_the_factor(spark):
    v = vectors(600, 9)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    exact = {(r.query_id, r.vec_id) for r in vptree.nearest(df).collect()}
    near = {(r.query_id, r.vec_id) for r in vptree.nearest(df, factor=0.8).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
