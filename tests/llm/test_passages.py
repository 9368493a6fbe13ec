import random

import pytest

from fieldloom.llm import queries, repeats

from .test_repeats import brute, corpus, covered_by_words


def texts(rnd, n):
    return " ".join(rnd.choice(["a", "to", "of", "in", "he", "we", "é", "go", "at", "by"]) + rnd.choice("abcdefg") * rnd.randint(0, 1) for _ in range(n))


@pytest.mark.parametrize(("size", "segment"), [(4000, 1 << 20), (2, 1 << 9)])
def test_stretches_apart_are_those_of_brute_force(spark, monkeypatch, size, segment):
    monkeypatch.setattr(repeats, "CLASS", size)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rnd = random.Random(size)
    passage, less = texts(rnd, 70), texts(rnd, 50)
    cut = passage.split(" ")
    kinds = [passage, " ".join(cut[: rnd.randint(51, 60)]), " ".join(cut[9:]), less, "", passage.replace(" ", "\n", 5)]
    rows = [(i, f"{texts(rnd, rnd.randint(0, 90))} x{i} " + rnd.choice(kinds) + f" y{i} {texts(rnd, 9)}") for i in range(40)]
    rows += [(50, corpus(1)[0][1]), (51, passage), (51, passage), (None, "na " * 60), (52, None), (53, ""), (54, rows[3][1]), (55, texts(rnd, 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.find_repeats(df, length=240, words=51, apart="passages").collect()
    found = sorted(repr((r.doc_id, r.text, [(x.s, x.e) for x in r.repeats], [(x.s, x.e) for x in r.passages])) for r in got)
    spans = brute(rows, 240)
    both = covered_by_words(rows, 51, 240, spans)
    assert spans != both
    assert found == sorted(repr((d, t, s, p)) for (d, t), s, p in zip(rows, spans, both, strict=True))


def test_op7_text_is_without_passages_of_51_words(spark, tmp_path):
    rnd = random.Random(5)
    passage = texts(rnd, 60)
    assert len(passage.encode()) < 400
    rows = [(i, f"{texts(rnd, 80)} x{i} {passage} y{i} {texts(rnd, 20)}") for i in range(2)] + [(2, texts(rnd, 200)), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert all(r.n_removed == 0 and r.n_spans == 0 for r in got.values())
    for d, t in rows[:2]:
        assert got[d].text == t.replace(passage, "")
    assert got[2].text == rows[2][1] and got[3].text is None


def test_long_texts_are_taken_in_parts(monkeypatch):
    b = (texts(random.Random(2), 3000) + " " + "long" * 200 + " " + texts(random.Random(4), 300)).encode()
    whole = repeats._stretches(b, 51)
    want = sorted((s, e) for _, s, e in whole if e - s < 400)
    for segment in (1 << 20, 1 << 10):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        begin, until, _ = repeats.Anchors(400).of_words(repeats.np.frombuffer(b, "u1"), 51)
        got = [(int(s) + x, int(s) + y) for s, e in zip(begin, until, strict=True) for _, x, y in repeats._stretches(b[s:e], 51)]
        assert sorted(got) == want
