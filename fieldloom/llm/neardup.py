"""MinHash near-duplicates: universal hash minima, banding, signature check, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, partitions
from .textkit import MinHash, Union, WordHashes, band_keys, fingerprint, runs, shingle_set

BUCKET = 4096  #: signatures compared in one block of a bucket
BLOCK_SHINGLES = 2_000_000  #: shingles held at once in one block of a candidate group
ROW_KEY = ("_no_id", "_id", "_th")
FEATURES = "doc_id long, th long, n_shingles long, fp binary, sig binary"


def _features(ngram: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, minhash = WordHashes(), MinHash(hashes)
        for batch in batches:
            n, fp, sig = [], [], []
            for text in batch.column("text"):
                values = shingle_set(text.as_py(), ngram, cache)
                n.append(len(values))
                fp.append(fingerprint(values) if len(values) else None)
                sig.append(minhash.minima(values).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "th", "n_shingles", "fp", "sig"],
            )

    return run


def _bands(rows: int, signed: bool):
    """One row for each band of each node: its key and, if ``signed``, the low byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sigs = np.vstack([np.frombuffer(s.as_buffer(), np.uint32) for s in part.column("sig")])
                keys = band_keys(sigs, rows)
                out = [pa.array(keys.ravel().view(np.int64))]
                if signed:
                    pick = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                    low = pa.array([x.tobytes() for x in sigs.astype(np.uint8)], pa.binary())
                    out += [part.column("fp").take(pick), low.take(pick)]
                yield pa.RecordBatch.from_arrays(out, ["key", "fp", "low"][: len(out)])

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, one key after another, from a partition sorted by ``by``."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.r_[np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest(low: np.ndarray, least: int, half: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of pairs that agree in at least ``least`` minima.

    ``half``: of two blocks, only pairs across them count."""
    left = np.ones(len(low), bool)
    edges = []
    for start in range(len(low)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            u = stack.pop()
            rest = np.flatnonzero(left if half is None else left & (half != half[u]))
            if not len(rest):
                continue
            near = rest[(low[rest] == low[u]).sum(axis=1) >= least]
            left[near] = False
            edges += [(u, int(v)) for v in near]
            stack += near.tolist()
    return edges


def _candidates(least: int):
    """Buckets -> edges that join all nodes of a bucket whose signatures may belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a.clear()
            b.clear()
            return out

        for group in _groups(batches, ["key", "i", "j"]):
            if group.num_rows < 2:
                continue
            fp = group.column("fp").to_pylist()
            low = np.vstack([np.frombuffer(x, np.uint8) for x in group.column("low").to_pylist()])
            if group.num_rows == 2:
                edges = [(0, 1)] if int((low[0] == low[1]).sum()) >= least else []
            else:
                i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
                edges = _forest(low, least, None if i == j else np.array(group.column("block").to_pylist()))
            for u, v in edges:
                a.append(fp[u])
                b.append(fp[v])
            if len(a) > 20_000:
                yield flush()
        yield flush()

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def exact_links(sets: list[np.ndarray], percent: int, half: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links with 100 * intersection >= percent * union, as many as join the sets into components.

    Sets with the most widely shared members go first; each is held against all others at once, and
    the search ends as soon as everything is one component, so a group of copies takes few passes.
    """
    n = len(sets)
    if n == 2:
        return [(0, 1)] if _linked(sets[0], sets[1], percent) and (half is None or half[0] != half[1]) else []
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    _, member, share = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    hub = np.add.reduceat(share[member].astype(np.float64), starts) / sizes
    union, edges = Union(n), []
    here = np.zeros(len(share), np.int32)
    for u in np.argsort(-hub, kind="stable"):
        if union.groups == 1:
            break
        own = member[starts[u] : starts[u] + sizes[u]]
        here[own] = 1
        both = np.add.reduceat(here[member], starts)
        here[own] = 0
        near = 100 * both >= percent * (sizes[u] + sizes - both)
        if half is not None:
            near &= half != half[u]
        for v in np.flatnonzero(near):
            if union.join(int(u), int(v)):
                edges.append((int(u), int(v)))
    return edges


def _verify(ngram: int, percent: int):
    """Texts of a candidate group -> (a, b, whole): verified links, or a star for each component
    (every node with the component's first node) where the whole group was at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        a, b, whole = [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(whole, pa.bool_())], ["a", "b", "whole"])
            for x in (a, b, whole):
                x.clear()
            return out

        for group in _groups(batches, ["label", "i", "j"]):
            sets: dict[bytes, tuple] = {}
            for text, fp, block in zip(group.column("text"), group.column("fp").to_pylist(), group.column("block").to_pylist(), strict=True):
                if fp not in sets:
                    values = shingle_set(text.as_py(), ngram, cache)
                    if fingerprint(values) == fp:
                        sets[fp] = (values, block)
            if len(sets) < 2:
                continue
            names = list(sets)
            i, j, blocks = (group.column(c)[0].as_py() for c in ("i", "j", "blocks"))
            half = None if i == j else np.array([sets[x][1] for x in names])
            edges = exact_links([sets[x][0] for x in names], percent, half)
            if blocks == 1:
                union = Union(len(names))
                for u, v in edges:
                    union.join(u, v)
                least: dict[int, bytes] = {}
                for u, x in enumerate(names):
                    r = union.find(u)
                    least[r] = min(x, least.get(r, x))
                pairs = [(x, least[union.find(u)]) for u, x in enumerate(names)]
            else:
                pairs = [(names[u], names[v]) for u, v in edges]
            a += [x for x, _ in pairs]
            b += [y for _, y in pairs]
            whole += [blocks == 1] * len(pairs)
            if len(a) > 20_000:
                yield flush()
        yield flush()

    return run


def _in_blocks(df: DataFrame, id_col: str, blocks: str) -> DataFrame:
    """Rows of a key of ``blocks`` > 1 blocks go to every pair (i <= j) of blocks that holds theirs."""
    df = df.withColumn("block", F.pmod(F.xxhash64(id_col), F.col(blocks)).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col(blocks) - 1),
        lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")),
    )
    return df.withColumn("p", F.explode(pairs)).withColumns({"i": F.col("p.i"), "j": F.col("p.j")}).drop("p")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(partitions(df), key, "i", "j").sortWithinPartitions(key, "i", "j")


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``ROW_KEY``: the id (null ids apart, and last) and the hash of the text."""
    i = F.col(id_col).cast("long")
    return docs.withColumns({"_no_id": i.isNull(), "_id": F.coalesce(i, F.lit(0)), "_th": F.xxhash64(F.col(text_col).cast("string"))})


def _owned(docs: DataFrame, ngram: int, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The features of each row, and for each node its least row ``rep`` and the label of its component."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("th", F.xxhash64("text"))
    features = materialize(source.mapInArrow(_features(ngram, bands * rows), FEATURES), "minima")
    shingled = features.filter("n_shingles > 0")
    nodes = shingled.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = materialize(nodes, "nodes")

    hot = nodes.select("sig").mapInArrow(_bands(rows, False), "key long").groupBy("key").count().filter(F.col("count") > BUCKET)
    hot = materialize(hot.select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("blocks")), "hot")
    rows_in = nodes.select("fp", "sig").mapInArrow(_bands(rows, True), "key long, fp binary, low binary")
    n_hot = hot.count()
    whole = {"block": F.lit(0), "i": F.lit(0), "j": F.lit(0)}
    if n_hot:
        keys = F.broadcast(hot) if n_hot <= 20_000 else hot
        dealt = _in_blocks(rows_in.join(keys, "key"), "fp", "blocks").drop("blocks")
        rows_in = rows_in.join(keys, "key", "left_anti").withColumns(whole).unionByName(dealt)
    else:
        rows_in = rows_in.withColumns(whole)
    p, total = percent / 100, bands * rows
    least = int((p + (1 - p) / 256 - 6 * (p * (1 - p) / total) ** 0.5) * total)
    edges = _dealt(rows_in, "key").mapInArrow(_candidates(least), "a binary, b binary").distinct()
    groups = connected_components(edges)

    listed = nodes.select("fp", "rep", "n").join(groups, F.col("fp") == F.col("node")).select("fp", "rep", "n", "label")
    sizes = listed.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    listed = listed.join(sizes, "label").select("label", "fp", "blocks", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    listed = materialize(listed, "groups")
    # Never broadcast: the list of grouped documents grows with the input.
    texts = listed.hint("merge").join(source, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    texts = _in_blocks(texts.select("label", "fp", "blocks", "text"), "fp", "blocks")
    links = _dealt(texts, "label").mapInArrow(_verify(ngram, percent), "a binary, b binary, whole boolean")
    links = materialize(links, "links")
    rest = links.filter("not whole").select("a", "b")
    labels = links.filter("whole").select(F.col("a").alias("fp"), F.col("b").alias("label"))
    if not rest.isEmpty():
        labels = labels.unionByName(connected_components(rest).select(F.col("node").alias("fp"), "label"))

    owned = nodes.select("fp", "rep").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return features, owned


def kept_rows(docs: DataFrame, ngram: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ROW_KEY`` (see ``with_row_key``) of one row per component of ``near_duplicates``: that of the
    smallest id, null ids last, and of equal ids that of the smallest text hash. Rows without shingles,
    which are linked with nothing, are all in it. No key occurs twice, so equal rows share one.
    """
    features, owned = _owned(docs, ngram, percent, bands, rows, id_col, text_col)
    key = lambda i, th: [i.isNull().alias("_no_id"), F.coalesce(i, F.lit(0)).alias("_id"), th.alias("_th")]
    least = owned.groupBy("label").agg(F.min("rep").alias("rep")).select(*key(F.col("rep.doc_id"), F.col("rep.th")))
    bare = features.filter("n_shingles = 0").select(*key(F.col("doc_id"), F.col("th"))).distinct()
    return least.unionByName(bare)


def near_duplicates(
    docs: DataFrame,
    ngram: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * |intersection| >= percent * |union| of their ``ngram``-word shingle
    sets (A-Z lower-cased, words apart at ASCII white space). Equal sets are one node. ``bands * rows``
    universal hash minima make a signature; nodes meet in a bucket if the ``rows`` minima of a band are
    equal (24 x 4: a pair of similarity 0.8 is missed with probability 3e-6). In each bucket the pairs
    whose signatures agree within six standard deviations of the threshold are joined by a spanning
    forest; the components of these edges are the candidate groups, and inside each all links are
    found on the full sets. Buckets and groups too large for one task are dealt out as pairs of
    blocks, so nothing is capped. Components come from alternating large-star and small-star.

    Null or empty text: n_shingles 0, linked with nothing. Fewer words than ``ngram``: one shingle.
    Repeated rows and ids: one result row each; component_id is the smallest doc_id reachable, kept
    says whether it is the row's own (null ids are only smallest where all are null). An empty table
    gives an empty result. Other columns of ``docs`` are not looked at.
    """
    features, owned = _owned(docs, ngram, percent, bands, rows, id_col, text_col)
    least_id = owned.groupBy("label").agg(F.min("rep.doc_id").alias("component_id"))
    of_node = owned.join(least_id, "label").select(F.col("fp").alias("node_fp"), "component_id")
    out = features.select("doc_id", "n_shingles", "fp").join(of_node, F.col("fp") == F.col("node_fp"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
