"""Columns whose names clash with those that operators use or add, in any case, do no harm."""

import random

import pytest

import corpus_pipeline
from fieldloom.llm import backoff, chat, licenses, merkle, neardup, packing, pieces, quality, repeats, sharding, trie, vptree

NAMES = (
    "m0", "q01", "_k0", "_keys", "_row", "N_WORDS", "Kept", "Distance", "x_length", "Pieces", "Decoded", "Repeats", "_r_k1", "_r_k2", "k1", "k2", "row", "wanted", "spans",
    "ah", "ch", "key", "start", "bucket", "batch", "slot", "Shard", "_rank", "_at", "_part", "Rank", "n_tokens", "Component_Id", "n_shingles", "a", "b", "fp", "low",
    "level", "p", "tree", "digest", "pos", "Depth", "ident", "window", "Role_", "size", "dim", "kind", "query_id", "Score", "vector", "held", "licence", "License",
)


def named(df):
    return df.selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(NAMES)))


@pytest.fixture
def docs(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"word{rnd.randrange(200)}" for _ in range(rnd.randint(0, 120))), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1] + " " + rows[1][1], "en", "s1"), (101, rows[0][1], "en", None), (102, None, None, "s1"), (0, rows[0][1], "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars")
    return df


OPERATORS = {
    "pack": lambda d: packing.pack_documents(d),
    "quality": lambda d: quality.with_quality(d),
    "stats": lambda d: quality.with_stats(d, d.columns),
    "pieces": lambda d: pieces.decode_pieces(pieces.encode_pieces(d, decoded=True)),
    "licenses": lambda d: licenses.license_scan(d),
    "find": lambda d: repeats.find_repeats(d, length=200),
    "cut": lambda d: repeats.without_repeats(d, length=200),
    "shards": lambda d: sharding.interleave(d, shards=5),
    "near": lambda d: neardup.near_duplicates(d, ngram=4, percent=80),
    "backoff": lambda d: backoff.backoff_scores(d),
    "merkle": lambda d: merkle.merkle_proofs(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(docs, name):
    run = OPERATORS[name]
    plain, clashing = run(docs), run(named(docs))
    own = [c for c in plain.columns if c in clashing.columns and c not in NAMES]
    exact = lambda df: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.select(*own).collect())
    assert exact(plain) == exact(clashing)
    low = [c.lower() for c in clashing.columns]
    assert len(set(low)) == len(low)
    if name in ("quality", "find", "cut"):  # given columns stay
        assert {"m0", "_k0", "_row", "_r_k1", "ah", "bucket"} <= set(clashing.columns)
        assert clashing.filter(f"m0 <> 0 OR ah <> {NAMES.index('ah')}").count() == 0


def test_conversations_and_vectors(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.read_windows(chat.chat_windows(named(turns)))).count() == 2
    assert trie.conversation_trie(trie.forked(named(turns))).count() == trie.conversation_trie(trie.forked(turns)).count()
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in vptree.nearest(named(vectors).drop("query_id", "vec_id_")).collect()] == [(0, 1, 1)]


def test_pipeline_stages(spark, docs):
    table = named(docs)
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, table, "").columns == corpus_pipeline.COLUMNS, name
