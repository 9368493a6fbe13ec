"""An inverted index as a table of blocks: batch BM25 that reads only blocks which can matter.

A block is a run of passages in the order of their ids, a few thousand at most. A row is (block, term): how
many passages of the block hold the term, bounds of what it can add to a score there, and the places of
these passages in the block, as gaps, with their counts. The bounds are narrow columns; the postings of a
block are read for a query only if its bounds, added up, reach the score that the query's best blocks
have already given ``limit`` passages. A block is scored by one task, which passes on its best passages only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import sized, stored
from .search import ranked, tokens

SLACK = 1e-6  #: sums of doubles may differ in their last bits
BLOCK_BITS = 13  #: a block holds 2 ** BLOCK_BITS passages at most
PART_BITS = 40  #: a block's number is its part's, shifted by so many bits, and a number within the part


def with_places(rows: DataFrame, part: str, key: str) -> DataFrame:
    """Adds ``_block`` and ``_row``, the place of a row in its block. All rows of a part are in one partition;
    they are sorted by part and key there."""
    at = F.monotonically_increasing_id()
    sorted_rows = rows.sortWithinPartitions(part, key).withColumn("_at", at)
    block = F.shiftleft(F.col(part).cast("long"), PART_BITS) + F.shiftright("_at", BLOCK_BITS)
    return sorted_rows.withColumns({"_block": block, "_row": F.col("_at").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")}).drop("_at")


def _gaps(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.diff(at, prepend=0)
    out[starts] = at[starts]
    return out


def postings(passages: DataFrame) -> DataFrame:
    """``passages(_block, _row, point_id, text)``, in this order -> ``block, term, n, max_tf, min_size, at, tf`` (``at``:
    gaps between places; term null: the block's own rows, with its number of passages as ``n``, of those with a
    text as ``texts``, of words as ``words``, and their ``at``, ``ids`` and ``sizes``). A block that is cut by two
    batches of rows has several rows a term. Nothing is shuffled."""
    kind = dict(passages.dtypes)["point_id"]
    out = f"block long, term string, n long, max_tf int, min_size int, texts long, words long, at array<int>, tf array<int>, ids array<{kind}>, sizes array<int>"

    def made(b):
        rows = len(b)
        block, place = b.column("_block")[0].as_py(), b.column("_row").to_numpy()
        size = b.column("size")
        sizes = size.fill_null(0).to_numpy(zero_copy_only=False)
        lists = b.column("w")
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        key, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * rows + row, return_counts=True)
        term, row = key // rows, key % rows
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        offsets = pa.array(np.append(starts, len(term)), pa.int32())
        n = len(starts)
        nulls = lambda t: pa.nulls(n, t)
        at = pa.array(_gaps(place[row], starts) if n else [], pa.int32())
        spread = pa.ListArray.from_arrays
        columns = [
            pa.array(np.full(n, block)), words.dictionary.take(pa.array(term[starts])), pa.array(np.diff(np.append(starts, len(term))), pa.int64()),
            pa.array(np.maximum.reduceat(tf, starts) if n else [], pa.int32()), pa.array(np.minimum.reduceat(sizes[row], starts) if n else [], pa.int32()),
            nulls(pa.int64()), nulls(pa.int64()), spread(offsets, at), spread(offsets, pa.array(tf, pa.int32())), nulls(pa.list_(b.column("point_id").type)), nulls(pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)
        whole = pa.array([0, rows], pa.int32())
        one = lambda v, t: pa.array([v], t)
        yield pa.RecordBatch.from_arrays(
            [
                one(block, pa.int64()), one(None, pa.string()), one(rows, pa.int64()), one(None, pa.int32()), one(None, pa.int32()), one(rows - size.null_count, pa.int64()),
                one(int(sizes.sum()), pa.int64()), spread(whole, pa.array(_gaps(place, np.array([0])), pa.int32())), pa.nulls(1, pa.list_(pa.int32())),
                spread(whole, b.column("point_id")), spread(whole, pa.array(sizes, pa.int32())),
            ],
            names,
        )

    names = [c.split()[0] for c in out.split(", ")]

    def build(batches):
        for b in batches:
            if len(b):
                cuts = np.flatnonzero(np.diff(b.column("_block").to_numpy())) + 1
                for start, end in zip([0, *cuts], [*cuts, len(b)], strict=True):
                    yield from made(b.slice(start, end - start))

    rows = passages.select("_block", "_row", "point_id", tokens(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    return rows.mapInArrow(build, out)


def _weight(tf: Column, size: Column, k1: float, b: float) -> Column:
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / F.col("avg_size")))


def search(index: DataFrame, queries: DataFrame, limit: int, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The hits of ``search.bm25`` over the passages of an index, and the (query_id, block, bound) that were
    read for them. ``queries(query_id, query)``; ``allowed(_block, _row)``: only these passages can be hits,
    while frequencies are those of all."""
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "asked")
    kinds = dict(asked.dtypes)["query_id"], dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    terms = sized(asked.select("term").distinct())
    sums = index.filter("term IS NULL").agg(F.sum("n").alias("n_docs"), (F.sum("words") / F.sum("texts")).alias("avg_size"))
    narrow = index.filter("term IS NOT NULL").select("block", "term", "n", "max_tf", "min_size").join(terms, "term", "left_semi")
    narrow = stored(narrow.groupBy("block", "term").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_size").alias("min_size")), "bounds")
    df = narrow.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(sums))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(df.select("term", idf.alias("idf"), "avg_size"), "weights")
    words = asked.join(sized(weights), "term")
    bounds = words.join(narrow, "term").groupBy("query_id", "block").agg(F.sum(_weight(F.col("max_tf"), F.col("min_size"), k1, b)).alias("bound"))
    bounds = stored(bounds, "query_blocks")
    # Each (block, term) is read once, whatever the number of queries that want it.
    wide = index.select("block", "term", "at", "tf", "ids", "sizes")
    wide = wide.filter("term IS NULL").unionByName(wide.filter("term IS NOT NULL").join(terms, "term", "left_semi").select(*wide.columns))
    everything = allowed is None
    places = None if allowed is None else allowed.groupBy("_block").agg(F.collect_list("_row").alias("_rows"))

    def best(of_block: pa.Table, wanted: pa.Table) -> pa.Table:
        sizes, fits = np.ones(1 << BLOCK_BITS), np.full(1 << BLOCK_BITS, everything)
        where, ids, found, out = np.zeros(1 << BLOCK_BITS, np.int64), [], {}, []
        for own, term, gaps, tf, own_ids, own_sizes in zip(*(of_block[c] for c in ("own", "term", "at", "tf", "ids", "sizes")), strict=True):
            at = gaps.values.to_numpy()
            if own.as_py() == 2:
                fits[at] = True
            elif own.as_py():
                at = np.cumsum(at)
                sizes[at] = own_sizes.values.to_numpy()
                where[at] = sum(map(len, ids)) + np.arange(len(at))
                ids.append(own_ids.values)
            else:
                found.setdefault(term.as_py(), []).append((np.cumsum(at), tf.values.to_numpy()))
        asked_here: dict = {}
        for q, t, w, mean in zip(*(wanted[c].to_pylist() for c in ("query_id", "term", "idf", "avg_size")), strict=True):
            asked_here.setdefault(q, []).append((t, w, mean))
        for q, own_terms in asked_here.items():
            score = np.zeros(1 << BLOCK_BITS)
            for t, w, mean in own_terms:
                for at, tf in found.get(t, ()):
                    score[at] += w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[at] / mean))
            hit = np.flatnonzero(fits & (score > 0))
            score = np.round(score[hit], 9)
            top = np.lexsort((hit, -score))[:limit]  # places are in the order of ids
            out.append(([q] * len(top), where[hit[top]], score[top]))
        at = pa.array(np.concatenate([o[1] for o in out]) if out else [], pa.int64())
        point = pa.concat_arrays(ids).take(at) if ids else pa.nulls(0, of_block.schema.field("ids").type.value_type)
        return pa.table({"query_id": pa.array([q for o in out for q in o[0]], wanted.schema.field("query_id").type), "point_id": point, "score": pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.float64())})

    def scored(pairs: DataFrame) -> DataFrame:
        here = sized(pairs.select("block").distinct())
        own = wide.join(here, "block", "left_semi").withColumn("own", F.col("term").isNull().cast("int"))
        if places is not None:
            fit = places.withColumnRenamed("_block", "block").join(here, "block", "left_semi")
            own = own.unionByName(fit.select("block", F.col("_rows").alias("at"), F.lit(2).alias("own")), allowMissingColumns=True)
        wanted = words.join(sized(pairs.select("query_id", "block")), "query_id").groupBy("block")
        return ranked(own.groupBy("block").cogroup(wanted).applyInArrow(best, f"query_id {kinds[0]}, point_id {kinds[1]}, score double"), limit)

    # Each of a query's blocks holds a passage at least, so the best `limit` blocks give as many.
    order = bounds.withColumnRenamed("bound", "score")
    first = stored(ranked(order, limit, "block"), "first")
    hits = stored(scored(first), "hits")
    least = hits.filter(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(sized(least), "query_id", "left")
    rest = stored(rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "block", "bound"), "rest")
    both = hits.drop("rank").unionByName(scored(rest).drop("rank"))
    read = first.select("query_id", "block", F.col("score").alias("bound")).unionByName(rest)
    return ranked(both, limit), read
