"""Packing: length buckets that waste the least padding, and token-budget batches inside each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, with_rank
from .tokens import encode_all, word_bpe


def with_token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", extra: int = 1) -> DataFrame:
    """``doc_id, n_tokens``: ids of each whole text plus ``extra`` (the end id); null text: 0 + extra."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes = [len(x) + extra for x in encode_all(table, part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return source.mapInArrow(run, "doc_id long, n_tokens long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over sorted distinct ``lengths`` with the least padding.

    Dynamic programming: best[k][j] pads the j shortest lengths in k buckets, the last of which ends
    at length j; every split point is tried at once.
    """
    m = len(lengths)
    if m == 0:
        return []
    c = np.r_[0.0, np.cumsum(counts, dtype=np.float64)]
    s = np.r_[0.0, np.cumsum(lengths * counts, dtype=np.float64)]
    top = np.r_[0.0, lengths.astype(np.float64)]
    cost = top[None, :] * (c[None, :] - c[:, None]) - (s[None, :] - s[:, None])  # bucket (i, j]
    cost[np.tril_indices(m + 1)] = np.inf
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    choice, totals = [], []
    for _ in range(min(buckets, m)):
        total = best[:, None] + cost
        choice.append(total.argmin(axis=0))
        best = total.min(axis=0)
        totals.append(best[m])
    k = int(np.argmin(totals))
    ends, j = [], m
    for step in range(k, -1, -1):
        ends.append(int(lengths[j - 1]))
        j = int(choice[step][j])
    return ends[::-1]


def pack(counts: DataFrame, buckets: int = 12, max_tokens: int = 2048, budget: int = 32768, seed: int = 17) -> DataFrame:
    """``counts(doc_id, n_tokens)`` -> one row per sequence: ``doc_id, piece, start, n_tokens, bucket,
    padded_to, batch, slot``.

    Texts longer than ``max_tokens`` become pieces of that length and a rest; no token is dropped. The
    histogram of piece lengths over all rows (at most ``max_tokens`` lengths) chooses the bucket ends.
    Inside each bucket the pieces, in seeded order, fill batches of ``budget // padded_to`` rows (at
    least one); only a bucket's last batch has fewer. Batches are numbered within their bucket.

    Rows without tokens or with a null count give no sequence; repeated rows give a sequence each.
    """
    if buckets < 1 or max_tokens < 1 or budget < 1:
        raise ValueError("buckets, max_tokens and budget must be positive")
    pieces = counts.filter("n_tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / max_tokens))))
    start = F.col("piece") * max_tokens
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(max_tokens), F.col("n_tokens") - start).alias("n_tokens"))
    histogram = pieces.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # at most max_tokens rows
    ends = best_boundaries(np.array([r[0] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), buckets)
    limits = F.array(*(F.lit(e) for e in ends)).cast("array<long>")
    bucket = F.size(F.filter(limits, lambda e: e < F.col("n_tokens")))
    placed = pieces.withColumn("bucket", bucket).withColumn("padded_to", F.element_at(limits, F.col("bucket") + 1) if ends else F.lit(0).cast("long"))
    ranked = with_rank(placed, ["bucket"], [F.xxhash64(F.lit(seed), "doc_id", "piece"), F.col("doc_id"), F.col("piece")], "_rank")
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("padded_to")))).cast("long")
    return ranked.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "padded_to",
        F.floor(F.col("_rank") / rows).alias("batch"),
        F.pmod(F.col("_rank"), rows).alias("slot"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """``pack`` for the token counts of whole texts, each with its end id (so null and empty texts are
    sequences of one token)."""
    return pack(materialize(with_token_counts(docs, path), "counts"), **how)
