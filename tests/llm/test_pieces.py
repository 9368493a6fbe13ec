import random

import numpy as np

from fieldloom.llm.pieces import PieceTable, decode_pieces, encode_pieces, piece_table
from fieldloom.llm.tokens import encode_all


def small():
    t = PieceTable.__new__(PieceTable)
    pieces = {p: (260 + i, -s) for i, (p, s) in enumerate([("▁", 3.0), ("a", 2.0), ("b", 2.5), ("ab", 3.0), ("▁a", 2.1), ("▁ab", 6.0), ("ba", 1.0), ("▁▁", 4.5), ("bab", 2.9)])}
    t.configure(pieces, list(range(3, 259)), 0, 300)
    return t, {p.replace("▁", " "): v for p, v in pieces.items()}


def best_score(text, pieces, penalty):
    """Plain dynamic programming over the whole text."""
    s = " " + text
    best = [0.0] + [-1e99] * len(s)
    for i in range(len(s)):
        for p, (_, score) in pieces.items():
            if s.startswith(p, i):
                best[i + len(p)] = max(best[i + len(p)], best[i] + score)
        if s[i] not in {p for p in pieces if len(p) == 1}:
            best[i + 1] = max(best[i + 1], best[i] + penalty)
    return best[-1]


def test_scores_are_the_best():
    t, pieces = small()
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice("ab  c\n▁é") for _ in range(rnd.randint(1, 14)))
        score = sum(t.segment(w)[1] for w in t.words(text))
        assert abs(score - best_score(text, pieces, t.penalty)) < 1e-9
        assert t.decode(np.array([i for w in t.words(text) for i in t.segment(w)[0]])) == text


def test_public_vocabulary_against_brute_force():
    t = piece_table(None)
    import sentencepiece

    from fieldloom.llm.tokens import public_path

    m = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    pieces = {m.id_to_piece(i).replace("▁", " "): (i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    for text in ("Rice needs water.", "été à la mer\n\nx", "日本 🙂 z"):
        assert abs(sum(t.segment(w)[1] for w in t.words(text)) - best_score(text, pieces, t.penalty)) < 1e-6


def test_round_trip(spark):
    texts = ["Rice needs water.", "", None, "  two  spaces ", "line\n\nline\t▁ mark", "日本語 🙂 \x00", "a" * 3000, "x " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS pieces", "2 AS decoded")
    got = {r.doc_id: r.decoded for r in decode_pieces(encode_pieces(df)).collect()}
    assert [got[i] for i in range(len(texts))] == texts
    assert encode_pieces(df.limit(0)).count() == 0
    ids = encode_all(piece_table(None), texts, limit=10)
    assert [len(x) for x in ids] == [len(x) for x in encode_all(piece_table(None), texts)]
