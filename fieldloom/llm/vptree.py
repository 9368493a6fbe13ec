"""Nearest neighbours by vantage-point trees, one for each shard of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions

LEAF = 128


class VpTree:
    """Vantage-point tree over unit vectors; distances are chords, for which the triangle inequality
    holds and which fall as the cosine rises."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, unit: np.ndarray, seed: int = 5):
        self.ids, self.rows, self.unit = ids, rows, unit
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        stack_result: list = [None]
        todo = [(rows, stack_result, 0)]
        while todo:
            rows, into, slot = todo.pop()
            if len(rows) <= LEAF:
                into[slot] = rows
                continue
            vantage = rows[self.rng.integers(len(rows))]
            d = np.sqrt(np.maximum(0.0, 2 - 2 * self.unit[rows] @ self.unit[vantage]))
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            radius = d[order[half - 1]]
            node = [vantage, radius, d[order[half]], None, None]
            into[slot] = node
            todo.append((rows[order[:half]], node, 3))
            todo.append((rows[order[half:]], node, 4))
        return stack_result[0]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, score) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best (ids, scores) for each unit query, its ``own`` row left out; a score of minus
        infinity where there are fewer.

        ``factor`` scales the radius within which subtrees are searched: 1 is exact, less prunes more.
        ``score(query rows, vector rows)`` gives the exact measure, by which the results are chosen.
        """
        n = len(queries)
        none = np.iinfo(np.int64).max
        best_id, best = np.full((n, k), none), np.full((n, k), -np.inf)
        stack = [(self.root, np.arange(n), np.zeros(n))]
        while stack:
            node, who, bound = stack.pop()
            worst = best[who, k - 1]
            reach = np.sqrt(np.maximum(0.0, 2 - 2 * np.where(worst == -np.inf, -1.0, worst))) + 1e-7
            who = who[bound <= reach * factor]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                s = score(who, node)
                s[self.rows[node][None, :] == own[who][:, None]] = -np.inf
                better = s.max(axis=1) >= best[who, k - 1]
                who, s = who[better], s[better]
                s = np.concatenate([best[who], s], 1)
                ids = np.concatenate([best_id[who], np.broadcast_to(self.ids[node], (len(who), len(node)))], 1)
                ids = np.where(s == -np.inf, none, ids)
                order = np.lexsort((ids, -s), axis=1)[:, :k]
                best_id[who], best[who] = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
                continue
            vantage, inner, outer, near, far = node
            d = np.sqrt(np.maximum(0.0, 2 - 2 * queries[who] @ self.unit[vantage]))
            close = d <= (inner + outer) / 2
            to_near, to_far = np.maximum(0.0, d - inner), np.maximum(0.0, outer - d)
            for child, to, first in ((far, to_far, ~close), (near, to_near, close)):  # the later side of each query
                later = ~first
                if later.any():
                    stack.append((child, who[later], to[later]))
            for child, to, first in ((far, to_far, ~close), (near, to_near, close)):  # on top: the side it lies in
                if first.any():
                    stack.append((child, who[first], to[first]))
        return best_id, best


def _cosines(a: np.ndarray, b: np.ndarray, a_norm: np.ndarray, b_norm: np.ndarray) -> np.ndarray:
    """Cosine of every pair, each summed alike wherever it stands, so equal vectors tie exactly."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] * b[None, :, :]).sum(axis=-1)
    return out / (a_norm[:, None] * b_norm[None, :])


def _matrix(part: pa.RecordBatch, dim: int) -> np.ndarray:
    return part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _search(k: int, factor: float, block_rows: int):
    """Rows sorted by shard, vectors before queries -> the best rows of each query in each shard. A
    shard's tree is built once, when its first query comes, and the queries go by in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                part, (dim, number, kind) = batch.slice(a, b - a), keys[a].tolist()
                if (dim, number) != shard:
                    shard, held, tree = (dim, number), [], None
                if not kind:
                    held.append(part)
                    continue
                if not held:  # a shard of queries only
                    continue
                if tree is None:
                    v = np.concatenate([_matrix(x, dim) for x in held])
                    ids, rows = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("vec_id", "row"))
                    v_norm = np.sqrt((v * v).sum(axis=1))
                    tree = VpTree(ids, rows, v / v_norm[:, None])
                for at in range(0, part.num_rows, block_rows):
                    block = part.slice(at, block_rows)
                    q, own, asked = _matrix(block, dim), block.column("row").to_numpy(), block.column("vec_id").to_numpy()
                    q_norm = np.sqrt((q * q).sum(axis=1))
                    found, score = tree.search(q / q_norm[:, None], own, k, factor, lambda i, j: _cosines(q[i], v[j], q_norm[i], v_norm[j]))  # noqa: B023
                    has = (score > -np.inf).ravel()
                    out = np.repeat(own, k)[has], np.repeat(asked, k)[has], found.ravel()[has], score.ravel()[has]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_row", "query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    factor: float = 1.0,
    shard_rows: int = 65_536,
    block_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest cosine for each row whose id is
    divisible by ``every``, that row left out; ties go to the smaller id.

    The vectors are dealt over shards of at most about ``shard_rows`` by a hash of id and content, and
    every shard searches all queries with one vantage-point tree, ``block_rows`` queries at a time.
    Subtrees are skipped if the triangle inequality puts all their vectors farther than ``factor``
    times the k-th best distance: with factor 1 the result is exact, below it faster and approximate.

    Null vectors or ids, zero vectors, and vectors with null or non-finite components take no part.
    Vectors are compared with those of their own dimension only; those whose squares a double can't
    hold are scaled by a power of two first. Each of the rows that repeat an id is a candidate of the
    others, and a query of its own. No rows give no rows.
    """
    if k < 1 or factor <= 0:
        raise ValueError("k and factor must be positive")
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    # By a power of two, which changes no digit; only vectors beyond the range of squares are scaled.
    most = F.array_max(F.transform("vector", F.abs))
    power = F.when((most > 1e150) | (most < 1e-150), F.pow(F.lit(2.0), F.least(F.lit(1000), -F.floor(F.log2(most))))).otherwise(1.0)
    scaled = F.transform("vector", lambda x: x * F.col("_power"))
    rows = rows.withColumn("_power", power).select("vec_id", F.when(F.col("_power") == 1.0, F.col("vector")).otherwise(scaled).alias("vector"))
    rows = materialize(rows.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}), "vectors")
    total, tasks = rows.count(), partitions(vectors)
    shards = max(1, -(-total // shard_rows), min(tasks, -(-total // 1024)))
    left = rows.select("dim", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "row", "vector")
    asked = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "row", "vector")
    both = left.unionByName(right).repartition(max(tasks, shards), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = both.mapInArrow(_search(k, factor, block_rows), "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
