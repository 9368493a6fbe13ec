"""The registered queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff import backoff_scores
from .chat import chat_windows, digests, read_windows
from .licenses import license_scan
from .merkle import merkle_proofs
from .neardup import near_duplicates
from .packing import pack_documents
from .pieces import encode_pieces
from .quality import SHARE, fit_outliers, judge, with_stats
from .rans import read_tokens, token_digests, write_tokens
from .repeats import find_repeats, kept_bytes, kept_text
from .sharding import interleave
from .shared import materialize, new_path
from .trie import conversation_trie, forked
from .vptree import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = materialize(with_stats(docs, ["doc_id", "lang", "source"]), "stats")
    return judge(stats, fit_outliers(stats, share=SHARE)).drop("lang", "source")


def op3_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), out, end_id=1)
    return token_digests(read_tokens(spark, out))


def op4_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = encode_pieces(docs, decoded=True)
    pieces = F.coalesce("pieces", F.unhex(F.lit("")))
    return decoded.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        (F.length(pieces) / 4).cast("long").alias("n_pieces"),
        F.crc32(pieces).alias("ids_crc32"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    more = spark.sql(
        "SELECT CAST(-7 AS BIGINT) conv_id, CAST(t AS BIGINT) turn, r role, '</s>[INST] ok [/INST]' text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)"
    )
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(more)
    return digests(read_windows(materialize(chat_windows(turns), "chat")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers and the digest are of 400-byte strings alone; of ``text``, stretches of 51 words that stand
    elsewhere too are cut as well, though they take fewer bytes."""
    found = find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, words=51, apart="passages")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digests, texts = [], [], [], [], []
            for text, repeats, passages in zip(*(batch.column(c).to_pylist() for c in ("text", "repeats", "passages")), strict=True):
                kept = kept_bytes(text, repeats)
                cut = sum(x["e"] - x["s"] for x in repeats)
                size.append(len(kept) + cut)
                removed.append(cut)
                spans.append(len(repeats))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept_text(text, passages))
            numbers = [pa.array(x, pa.int64()) for x in (size, removed, spans)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(digests, pa.string()), pa.array(texts, pa.string())], names)

    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(table(spark, sf_dir, "documents"), shards=24)
    return placed.drop("source").withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op9_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), ngram=4, percent=80)


def op11_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(forked(table(spark, sf_dir, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a fifth of the rows the text is tampered with: its A-Z are lower-cased."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return merkle_proofs(table(spark, sf_dir, "documents"), F.when(chosen, lower).otherwise(F.col("text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_length_bucket_packing,
        op2_quality_outliers,
        op3_rans_token_files,
        op4_sentencepiece_round_trip,
        op5_chat_windows,
        op6_license_scan,
        op7_suffix_array_dedup,
        op8_stratified_shards,
        op9_vantage_point_trees,
        op10_minhash_near_dedup,
        op11_backoff_automaton,
        op12_conversation_trie,
        op13_merkle_manifest,
    )
}


def _crc32(text: str) -> str:
    """DuckDB has no CRC-32: bit by bit over the characters of an ASCII string."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"""


def _merkle_sql(source_levels: int = 5, forest_levels: int = 4) -> str:
    """The trees level by level; each level is one step, and a tree that has reached its root stays as it is."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    steps = []

    def climb(nodes: str, docs: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"""
{nodes}g{k} AS (SELECT s, i // 16 AS p, string_agg(h, '' ORDER BY i) AS t, any_value(m) > 1 AS up
  FROM (SELECT *, count(*) OVER (PARTITION BY s) AS m FROM {nodes}{k}) GROUP BY s, i // 16),
{nodes}{k + 1} AS (SELECT s, p AS i, CASE WHEN up THEN sha256(t) ELSE t END AS h FROM {nodes}g{k}),
{docs}{k + 1} AS (SELECT d.* REPLACE (
    CASE WHEN up THEN i // 16 ELSE i END AS i,
    CASE WHEN up THEN sha256(substr(t, 1, 64 * (i % 16)) || f || substr(t, 64 * (i % 16) + 65)) ELSE f END AS f,
    CASE WHEN up THEN proof || substr(t, 1, 64 * (i % 16)) || substr(t, 64 * (i % 16) + 65) ELSE proof END AS proof)
  FROM {docs}{k} d JOIN {nodes}g{k} g ON d.s IS NOT DISTINCT FROM g.s AND d.i // 16 = g.p)""")

    climb("a", "d", source_levels)
    steps.append(f"""
b0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, h, s AS source FROM a{source_levels}),
e0 AS (SELECT d.doc_id, d.leaf, b0.h AS subroot, 0 AS s, b0.i, d.f, d.proof FROM d{source_levels} d JOIN b0 ON d.s IS NOT DISTINCT FROM b0.source)""")
    climb("b", "e", forest_levels)
    return f"""
WITH d0 AS (
  SELECT doc_id, source AS s, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, '' AS proof,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN changed ELSE leaf END AS f
  FROM (SELECT *, sha256({head} || {part("text")}) AS leaf,
    sha256({head} || {part("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed FROM documents)),
a0 AS (SELECT s, i, leaf AS h FROM d0),{",".join(steps)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM e{forest_levels} CROSS JOIN b{forest_levels} r
"""

ORACLES: dict[str, str] = {
    "op5_chat_windows": r"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
sized AS (
  SELECT *, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS tok,
    17 + length(role) + length(regexp_replace(role, '[^\n^<\[]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\^<\[]', '', 'g')) AS chars FROM turns),
placed AS (
  SELECT *, row_number() OVER o AS pos, sum(tok) OVER (o ROWS UNBOUNDED PRECEDING) AS till FROM sized
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (SELECT *, pos = 1 AND role = 'system' AS sys FROM placed),
led AS (SELECT *, max(CASE WHEN sys THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS st, max(CASE WHEN sys THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has FROM marked),
spans AS (SELECT *, CASE WHEN sys THEN -1 ELSE floor((till - st - 1) / greatest(1, floor((512 - st) / 2))) END AS span FROM led),
windows AS (SELECT *, greatest(0, dense_rank() OVER (PARTITION BY conv_id ORDER BY span) - 1 - has) AS w FROM spans),
starts AS (SELECT conv_id, w, min(pos) AS first, min(till - tok) AS since, 512 - any_value(st) - sum(tok) AS room FROM windows WHERE NOT sys GROUP BY conv_id, w),
pieces AS (
  SELECT conv_id, chars FROM windows
  UNION ALL SELECT h.conv_id, h.chars FROM windows h JOIN starts s ON h.conv_id IS NOT DISTINCT FROM s.conv_id
    WHERE NOT h.sys AND s.first - h.pos BETWEEN 1 AND 3 AND s.since - (h.till - h.tok) <= s.room
  UNION ALL SELECT h.conv_id, h.chars FROM windows h JOIN starts s ON h.conv_id IS NOT DISTINCT FROM s.conv_id WHERE h.sys AND s.w > 0),
formatted AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM pieces GROUP BY conv_id),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS t,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss FROM placed GROUP BY conv_id)
SELECT whole.conv_id, n_turns, sha256(t) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole JOIN formatted ON whole.conv_id IS NOT DISTINCT FROM formatted.conv_id
""",
    "op9_vantage_point_trees": r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (
  SELECT q.r AS query_row, q.vec_id AS query_id, v.vec_id AS vec_id, list_cosine_similarity(q.x, v.x) AS score
  FROM v q JOIN v ON q.r <> v.r AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 5
""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.d WHERE reach.r < e.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM sets s JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON m.d = s.doc_id
""",
    "op11_backoff_automaton": rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 10 = 0, false) AS held,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
places AS (SELECT r, doc_id, held, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM texts),
tokens AS (SELECT *, lag(w, 1, '  ') OVER (PARTITION BY r ORDER BY i) AS h FROM places),
uni AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held GROUP BY w),
total AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uni),
states AS (SELECT w AS h, c FROM uni UNION ALL SELECT '  ', count(*) FROM texts WHERE NOT held HAVING count(*) > 0),
pairs AS (SELECT h, w, count(*) AS c FROM tokens WHERE NOT held GROUP BY h, w HAVING count(*) >= 2),
mass AS (SELECT h, sum(c) AS m, count(*) AS k FROM pairs GROUP BY h),
weights AS (SELECT h, c, (c - coalesce(m, 0) + 0.75::DOUBLE * coalesce(k, 0)) / c AS g FROM states LEFT JOIN mass USING (h)),
scored AS (
  SELECT t.r, t.doc_id, t.held, coalesce(u.c, 0) AS c, (coalesce(u.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS base, x.c AS hc, x.g, p.c AS pc, n
  FROM tokens t CROSS JOIN total LEFT JOIN uni u ON u.w = t.w LEFT JOIN weights x ON x.h = t.h LEFT JOIN pairs p ON p.h = t.h AND p.w = t.w)
SELECT any_value(doc_id) AS doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
  sum(log10(base)) AS base_score, sum(log10(CASE WHEN pc IS NOT NULL THEN (pc - 0.75::DOUBLE) / hc + g * base ELSE coalesce(g, 1) * base END)) AS score
FROM scored GROUP BY r
""",
    "op12_conversation_trie": rf"""
WITH turns AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM turns),
counts AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id),
ids AS (SELECT a.conv_id, h, base, least(h, coalesce(b.n, 0)) AS taken
  FROM (SELECT conv_id, conv_id - conv_id % 5 AS base, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h FROM counts) a LEFT JOIN counts b ON b.conv_id = base),
rebuilt AS (
  SELECT i.conv_id, taken + pos - h + 1 AS depth, digest, strlen(text) AS size FROM ids i JOIN placed p ON p.conv_id = i.conv_id AND pos >= h
  UNION ALL SELECT i.conv_id, pos + 1, digest, strlen(text) FROM ids i JOIN placed p ON p.conv_id = base AND pos < h),
prefixes AS (
  SELECT conv_id, depth, size, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM rebuilt UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
nodes AS (SELECT key, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n FROM prefixes GROUP BY key, depth),
kids AS (SELECT left(key, CAST(64 * (depth - 1) AS BIGINT)) AS key, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (key)),
below AS (
  SELECT p.key, sum(CASE WHEN f.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.size) AS saved
  FROM full_nodes f JOIN prefixes p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.key),
last_depth AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM prefixes JOIN last_depth USING (conv_id, depth) GROUP BY key)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM full_nodes f JOIN below USING (key) LEFT JOIN ends USING (key)
LEFT JOIN nodes up ON f.depth > 0 AND up.key = left(f.key, CAST(64 * (f.depth - 1) AS BIGINT))
""",
    "op13_merkle_manifest": _merkle_sql(),
}
