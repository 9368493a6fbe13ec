import random
import re

import numpy as np
import pytest

from fieldloom.llm import repeats
from fieldloom.llm.gsaca import suffix_array


def test_suffix_array():
    rnd = random.Random(3)
    for _ in range(400):
        s = [rnd.randint(1, rnd.choice([1, 2, 4])) for _ in range(rnd.randint(0, 50))]
        s = (s * rnd.choice([1, 3]))[:90] + [0]
        assert suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length):
    where = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for k, (_, b) in enumerate(texts):
        for s in range(len(b) - length + 1):
            where.setdefault(b[s : s + length], []).append((k, s))
    starts = {}
    for v in where.values():
        if len(v) > 1:
            for k, s in v:
                starts.setdefault(k, []).append(s)
    return [repeats._covered(np.array(sorted(starts.get(k, []))), length) for k in range(len(texts))]


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(20)
    rows = []
    for i in range(40):
        t = text(rnd.randint(0, 120))
        cut = rnd.randint(0, len(passage) // 2)
        t += rnd.choice(["", passage, passage[cut:], passage[:-cut] if cut else "", "xy " * rnd.randint(0, 200), line + "\n" + line])
        rows.append((i, t + text(rnd.randint(0, 60))))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "z" * 700), (105, text(5) + "z" * 450), (106, rows[1][1] + rows[1][1])]
    return rows


@pytest.mark.parametrize("size", [4000, 2])
def test_covered_bytes_are_those_of_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(repeats, "CLASS", size)
    rows = corpus(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k1", "2 AS pos", "3 AS ah")
    got = {r.doc_id: [(x.s, x.e) for x in r.repeats] for r in repeats.find_repeats(df, length=200).collect()}
    assert [got[d] for d, _ in rows] == brute(rows, 200)


def test_long_texts_are_taken_in_segments(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 11)
    rnd = random.Random(1)
    b = np.frombuffer(bytes(rnd.randrange(97, 123) for _ in range(9000)), np.uint8)
    at, h, first, last = repeats.Anchors(400).of(b)
    assert first[0] == 0 and last[-1] == len(b) - 400 and (first[1:] == last[:-1] + 1).all()
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 20)
    whole = repeats.Anchors(400).of(b)
    assert set(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == set(zip(at.tolist(), h.tolist(), strict=True))


def test_odd_tables(spark):
    t = "é" * 300
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "short"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in repeats.without_repeats(df).collect())
    assert got == sorted([("1", ""), ("1", ""), ("None", ""), ("2", "short"), ("3", None)], key=lambda x: (x[0], str(x[1])))
    assert repeats.find_repeats(df.limit(0)).count() == 0


def covered_by_words(rows, words, below, spans):
    """Spans joined with all stretches of whole words that stand twice and take less than ``below`` bytes."""
    seen, places = {}, []
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)]
        for j in range(len(at) - words + 1):
            s, e = at[j][0], at[j + words - 1][1]
            if e - s < below:
                seen[b[s:e]] = seen.get(b[s:e], 0) + 1
                places.append((i, s, e, b[s:e]))
    out = []
    for i, own in enumerate(spans):
        marks = sorted([*own, *((s, e) for k, s, e, w in places if k == i and seen[w] > 1)])
        merged = []
        for s, e in marks:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out.append([tuple(x) for x in merged])
    return out


def test_stretches_of_short_words(spark):
    rnd = random.Random(11)
    short = lambda n: " ".join(rnd.choice(["a", "to", "of", "in", "he", "we", "é", "go", "at", "by"]) + rnd.choice("abcdefg") * rnd.randint(0, 1) for _ in range(n))
    passage, less = short(53), short(50)
    rows = [(i, f"{short(rnd.randint(0, 90))} x{i} " + rnd.choice([passage, less, "", passage.replace(" ", "\n")]) + f" y{i} {short(9)}") for i in range(40)]
    rows += [(50, corpus(1)[0][1]), (51, passage), (51, passage), (None, "na " * 60), (52, None), (53, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(repr((r.doc_id, r.text, [(x.s, x.e) for x in r.repeats])) for r in repeats.find_repeats(df, length=240, words=51).collect())
    assert got == sorted(repr((d, t, s)) for (d, t), s in zip(rows, covered_by_words(rows, 51, 240, brute(rows, 240)), strict=True))
    kept = {r.doc_id: r.text for r in repeats.without_repeats(df.filter("doc_id < 50"), length=240, least_words=51).collect()}
    for d, t in rows[:40]:
        if passage in t:
            assert passage not in kept[d] and f"x{d}" in kept[d] and f"y{d}" in kept[d]
        if less in t:
            assert less in kept[d]
