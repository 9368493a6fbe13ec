"""Backoff-automaton scores against a plain dictionary model."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from fieldloom.llm import backoff


def reference(rows, order, discount=0.75, least=2):
    tokens = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) + ["end"] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    counts = [Counter() for _ in range(order + 1)]
    for h, ws in zip(held, tokens, strict=True):
        if not h:
            seq = ["begin", *ws]
            for n in range(1, order + 1):
                counts[n].update(tuple(seq[i - n : i]) for i in range(n, len(seq) + 1))
    n_train = sum(c for k, c in counts[1].items() if k != ("begin",))
    n_words = sum(k != ("begin",) for k in counts[1])
    kept = [{k for k, c in counts[n].items() if c >= (1 if n == 1 else least)} for n in range(1, order + 1)]
    for n in range(2, order + 1):  # a kept n-gram's parts are kept, as they are at least as frequent
        assert all(k[1:] in kept[n - 2] and k[:-1] in kept[n - 2] for k in kept[n - 1])

    def base(w):
        return (counts[1].get((w,), 0) + 0.1) / (n_train + 0.1 * (n_words + 1))

    follow = {}
    for n in range(2, order + 1):
        for k in kept[n - 1]:
            follow.setdefault(k[:-1], []).append(counts[n][k])

    def chance(h, w):
        if not h:
            return base(w)
        if h not in kept[len(h) - 1]:
            return chance(h[1:], w)
        c = counts[len(h)][h]
        left = (c - sum(x - discount for x in follow.get(h, []))) / c
        seen = counts[len(h) + 1].get((*h, w), 0)
        return (max(0.0, seen - discount) / c if seen >= least else 0.0) + left * chance(h[1:], w)

    out = []
    for (d, _), h, ws in zip(rows, held, tokens, strict=True):
        seq = ["begin", *ws]
        score = sum(math.log10(chance(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        out.append((d, h, len(ws), sum((w,) in counts[1] for w in ws), n_train, sum(math.log10(base(w)) for w in ws), score))
    words = [k[0] for k in counts[1] if k != ("begin",)]
    return out, chance, words, kept


def corpus(n, seed=5):
    rnd = random.Random(seed)
    words = ["rice", "corn", "Rice", "price", "in", "the", "a", "of", "ñandú", "x,y"] + [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(words, [5] * 10 + [1] * 30, k=rnd.randint(0, 40))) for _ in range(n)]
    texts[3], texts[4], texts[5] = None, "", " \t\n"
    texts[6] = "\x0bthe\x0cprice\x1cof rice\rin " * 20
    texts[7:12] = [texts[20]] * 5
    ids = [*range(n - 2), None, 7]
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("order,bucket,stretch", [(1, 700_000, 256), (2, 700_000, 256), (3, 700_000, 256), (2, 37, 5), (3, 61, 4), (4, 50, 3)])
def test_scores_equal_a_plain_model(spark, monkeypatch, order, bucket, stretch):
    monkeypatch.setattr(backoff, "BUCKET", bucket)
    monkeypatch.setattr(backoff, "STRETCH", stretch)
    monkeypatch.setattr(backoff, "PIECE", 64)
    run = backoff._to_pieces
    monkeypatch.setattr(backoff, "_to_pieces", lambda k: _with_limits(run(k), bucket))
    walk = backoff._score
    monkeypatch.setattr(backoff, "_score", lambda *a: _with_limits(walk(*a), bucket, stretch))
    rows = corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "'x' AS row", "2 AS held", "3 AS Score")
    got = sorted(map(tuple, backoff.backoff_scores(df, order=order).collect()), key=repr)
    want = sorted(reference(rows, order)[0], key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def _with_limits(run, bucket, stretch=256):
    """The limits of the test, set in the worker as well."""

    def limited(batches):
        from fieldloom.llm import backoff as there

        there.BUCKET, there.STRETCH, there.PIECE = bucket, stretch, 64
        try:
            yield from run(batches)
        finally:
            there.BUCKET, there.STRETCH, there.PIECE = 700_000, 256, 4 << 20

    return limited


def test_chances_add_up_to_one():
    _, chance, words, kept = reference(corpus(200), 3)
    for h in [(), *list(kept[0])[:20], *list(kept[1])[:20]]:
        if "end" not in h:
            assert sum(chance(h, w) for w in words) + chance(h, b"never seen") == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    rnd = random.Random(8)
    follow = {w: rnd.sample(range(50), 3) for w in range(50)}
    texts = []
    for _ in range(300):
        w, out = rnd.randrange(50), []
        for _ in range(30):
            out.append(f"v{w}")
            w = rnd.choice(follow[w])
        texts.append(" ".join(out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = backoff.backoff_scores(df).filter("held_out")
    assert held.filter("score > base_score + 5").count() == held.count() > 10


def test_no_texts_and_no_training_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert backoff.backoff_scores(df).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = backoff.backoff_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]
