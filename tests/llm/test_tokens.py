import random
import zlib

import numpy as np
import pytest

from fieldloom.llm import rans
from fieldloom.llm.tokens import WordBpe, encode_all, public_path, word_bpe


def texts():
    rnd = random.Random(5)
    latin = "".join(map(chr, range(256)))
    out = ["".join(rnd.choice(latin + "   'stdm") for _ in range(60)) for _ in range(200)]
    return out + [latin, "a <|endoftext|> b", "Σ ΑΣ ΑΣΑ é é x", "\r\n \x0b q\x85z İ ﬁ", "", "  ", "日本語 text"]


def test_words_are_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    some = texts()
    for want, got in zip(some, encode_all(word_bpe(None), some, limit=500), strict=True):
        assert t.encode(want, add_special_tokens=False).ids == got.tolist(), want
    assert len(encode_all(word_bpe(None), [None])[0]) == 0


def test_new_words_go_to_the_model_and_known_ones_stay(spark):
    """Words of printable ASCII are not encoded as texts, and only new words are looked up again."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    table = WordBpe(public_path("word_bpe_49k.json"))
    words = ["rice", "\u00f1and\u00fa", "caf\u00e9", "zqxj", "!!!", "a\x01b", "Upper", "rice,", "7", "\x7f", "caf\u00e9"]
    assert [table._kind(w) for w in words[:9]] == [0, 1, 1, 0, 0, 2, 2, 2, 0]
    texts = []
    table.tokenizer = type("Counted", (), {"model": t.model, "encode_batch_fast": lambda self, x, **k: texts.append(x) or t.encode_batch_fast(x, **k)})()
    for limit in (table.LIMIT, 400):  # the second empties the table again and again
        table.LIMIT = limit
        for some in (words[:4], words, words[::-1], ["rice"], ["new", "rice"], words):
            ids, ends = table.ids_and_ends(some)
            want = [t.encode(w, add_special_tokens=False).ids for w in some]
            assert ids.tolist() == [i for x in want for i in x] and np.diff(ends, prepend=0).tolist() == [len(x) for x in want]
    assert texts and not any("rice" in x.split() for batch in texts for x in batch)


@pytest.mark.parametrize("n", [1, 7, 64, 1000, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 60000).astype(np.uint32)
    table = rans.Table(*np.unique(ids, return_counts=True))
    assert table.freq.sum() == 1 << rans.BITS
    docs = np.zeros(1, rans.DOC)
    block = rans.encode_block(ids, table, docs, lanes=16, step=4)
    assert (rans.decode_block(block, table, step=4) == ids).all()
    marks = -(-n // 64)
    parts = [rans.decode_block(block, table, k, k + 1, step=4) for k in range(marks)]
    assert (np.concatenate(parts) == ids).all()
    with pytest.raises(ValueError):
        rans.open_block(block[:-1] + bytes([block[-1] ^ 1]))


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_files_hold_the_ids_in_order(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(rans, "BLOCK", block)
    rows = [(i * 3, t) for i, t in enumerate(texts())] + [(5, None), (5, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS th", "2 AS part")
    rans.write_tokens(df, f"{tmp_path}/t")
    got = sorted(rans.token_digests(rans.read_tokens(spark, f"{tmp_path}/t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    known = {d: t for d, t in rows if d is not None and d != 5}
    for r in got:
        if r.doc_id in known:
            ids = np.append(encode_all(word_bpe(None), [known[r.doc_id]])[0], 1).astype("<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    rans.write_tokens(df, f"{tmp_path}/e")
    assert rans.token_digests(rans.read_tokens(spark, f"{tmp_path}/e")).count() == 0
