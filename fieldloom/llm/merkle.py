"""Merkle manifest of a dataset: a postorder log of nodes, and proofs read from it by position.

Each source is a tree over its rows, and the sources' roots are the leaves of one more tree. A tree of n
leaves and fan-out 16 is known from n alone, so the place of every node in postorder has a closed form.
Builders of aligned runs of leaves therefore write their nodes in the order in which they complete,
each at its final position, without knowing of one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neardup import _groups
from .shared import discard, materialize, partitions, with_rank

FAN = 16
HEIGHT = 3  #: levels that one builder completes: 4,096 leaves
LOG = "tree string, chunk long, level int, index long, pos long, digest string, n long"
PATHS = "tree string, index long, path array<struct<l:string,r:string>>, subroot string, root string, n long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def top_level(n: int) -> int:
    """The level on which one node remains of ``n`` leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // FAN), level + 1
    return level


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the postorder of a tree of ``n`` leaves.

    The node ends with leaf e. Before it completes, or with it, all nodes of its level and below complete
    that end with leaf e or earlier, the last run of a level with leaf n; above it, those that its
    own ancestor follows.
    """
    e = min(n, (index + 1) * FAN**level)
    below = sum(-(-e // FAN**j) for j in range(level + 1))
    above = sum(index // FAN ** (j - level) for j in range(level + 1, top_level(n) + 1))
    return below + above - 1


def append_log(digests: list[str], base: int, first: int, n: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes over an aligned run of level-``base`` nodes, the first of
    which has the index ``first``, as they complete; ``HEIGHT`` levels up, or to the tree's root."""
    end = min(base + HEIGHT, top_level(n))
    open_runs: list[list[str]] = [[] for _ in range(end - base)]
    widths = [-(-n // FAN**j) for j in range(base, end + 1)]
    for i, digest in enumerate(digests, first):
        level, index = base, i
        yield level, index, digest
        while level < end:
            run = open_runs[level - base]
            run.append(digest)
            if len(run) < FAN and index + 1 < widths[level - base]:
                break
            digest = sha("".join(run))
            run.clear()
            level, index = level + 1, index // FAN
            yield level, index, digest


def _build(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["tree", "chunk"]):
            rows = group.to_pylist()
            tree, chunk, n = rows[0]["tree"], rows[0]["chunk"], rows[0]["n"]
            nodes = append_log([r["digest"] for r in rows[1:]], base, rows[1]["rank"], n)
            out = [(tree, chunk, level, i, position(level, i, n), d, n) for level, i, d in nodes if level > base or not base]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["tree", "chunk", "level", "index", "pos", "digest", "n"])

    return run


def build_log(nodes: DataFrame) -> tuple[DataFrame, int]:
    """The log ``tree, chunk, level, index, pos, digest, n`` of the trees over ``nodes(tree, rank, digest)``,
    ranks gapless from 0 in each tree, and the greatest number of leaves of a tree.

    A builder holds 4,096 nodes of a level at most, so a tree with a third of all rows has as many
    builders as it needs; the roots of their runs are the next builders' nodes.
    """
    step = FAN**HEIGHT
    sizes = materialize(nodes.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    parts = partitions(nodes)
    base, log = 0, None
    while True:
        width = FAN**base
        heads = sizes.filter(F.col("n") > (0 if not base else width)).select(
            "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(((n + {width - 1}) div {width}) - 1) div {step}"))).alias("chunk"),
            F.lit(-1).cast("long").alias("rank"), F.lit(None).cast("string").alias("digest"), "n",
        )
        rows = heads.unionByName(nodes.select("tree", F.expr(f"rank div {step}").alias("chunk"), "rank", "digest", F.lit(None).cast("long").alias("n")))
        rows = rows.repartition(parts, "tree", "chunk").sortWithinPartitions("tree", "chunk", "rank")
        built = materialize(rows.mapInArrow(_build(base), LOG), "log")
        log = built if log is None else log.unionByName(built)
        base += HEIGHT
        if most <= FAN**base:
            discard(sizes)
            return log, most
        nodes = built.filter((F.col("level") == base) & (F.col("n") > FAN**base)).select("tree", F.col("index").alias("rank"), "digest")


class Segment:
    """The log of one builder, addressed by position."""

    def __init__(self, rows: list[dict], base: int, n: int):
        self.at = {r["pos"]: r["digest"] for r in rows}
        self.base, self.n, self.end = base, n, min(base + HEIGHT, top_level(n))
        self.runs: dict[tuple[int, int], str] = {}

    def run(self, level: int, parent: int) -> str:
        """The digests of the children of a node, joined."""
        if (level, parent) not in self.runs:
            last = min((parent + 1) * FAN, -(-self.n // FAN**level))
            self.runs[level, parent] = "".join(self.at[position(level, i, self.n)] for i in range(parent * FAN, last))
        return self.runs[level, parent]

    def siblings(self, index: int) -> list[dict]:
        """Left and right siblings of a level-``base`` node and of its ancestors in the segment."""
        out = []
        for level in range(self.base, self.end):
            parent, k = divmod(index, FAN)
            run = self.run(level, parent)
            out.append({"l": run[: 64 * k], "r": run[64 * (k + 1) :]})
            index = parent
        return out


def fold(digest: str, path: list[dict]) -> str:
    """The root that a digest leads to with the siblings of its path."""
    for x in path:
        digest = sha(x["l"] + digest + x["r"])
    return digest


PATH = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _paths(base: int):
    """Segments and the paths of their roots -> the paths of their level-``base`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["tree", "chunk"]):
            rows = group.to_pylist()
            head = rows[0]
            segment = Segment(rows[1:], base, head["n"])
            nodes = range(head["chunk"] * FAN**HEIGHT, min((head["chunk"] + 1) * FAN**HEIGHT, -(-head["n"] // FAN**base)))
            for at in range(nodes.start, nodes.stop, 512):
                part = range(at, min(at + 512, nodes.stop))
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([head["tree"]] * k, pa.string()),
                        pa.array(list(part), pa.int64()),
                        pa.array([segment.siblings(i) + head["path"] for i in part], PATH),
                        pa.array([head["subroot"]] * k, pa.string()),
                        pa.array([head["root"]] * k, pa.string()),
                        pa.array([head["n"]] * k, pa.int64()),
                    ],
                    ["tree", "index", "path", "subroot", "root", "n"],
                )

    return run


def _segments(log: DataFrame, paths: DataFrame, base: int, more: DataFrame | None = None) -> DataFrame:
    """Rows of each builder together: the path of its root, the nodes of its log, further rows."""
    step, none = FAN**HEIGHT, lambda kind: F.lit(None).cast(kind)
    extra = ["rank", "doc_id", "changed"]
    # A tree whose root stands below this level has no builder here.
    heads = paths.filter(F.col("n") > (0 if not base else FAN**base))
    rows = heads.select("tree", F.col("index").alias("chunk"), F.lit(0).alias("kind"), none("long").alias("pos"), none("string").alias("digest"), "path", "subroot", "root", "n", *(none("string" if c == "changed" else "long").alias(c) for c in extra))
    own = log.filter(F.col("level").between(base, base + HEIGHT - 1) & (F.col("n") > FAN ** F.col("level")))
    chunk = F.floor(F.col("index") / F.pow(F.lit(FAN), F.lit(base + HEIGHT) - F.col("level"))).cast("long")
    rows = rows.unionByName(own.select("tree", chunk.alias("chunk"), F.lit(1).alias("kind"), "pos", "digest"), allowMissingColumns=True)
    if more is not None:
        rows = rows.unionByName(more.select("tree", F.expr(f"rank div {step}").alias("chunk"), F.lit(2).alias("kind"), *extra), allowMissingColumns=True)
    return rows.repartition(partitions(log), "tree", "chunk").sortWithinPartitions("tree", "chunk", "kind")


def _bases(most: int) -> list[int]:
    return list(range(0, max(1, top_level(most)), HEIGHT))[::-1]


def node_paths(log: DataFrame, most: int, roots: DataFrame, least: int = 0) -> DataFrame:
    """``tree, index, path, subroot, root, n`` of the nodes of level ``least`` (a builder's base), from
    the paths of the trees' roots, builder by builder from the top down.

    A tree that ends below a builder's base hands its root's path on as it is."""
    paths = roots
    for base in _bases(most):
        if base < least:
            break
        down = _segments(log, paths, base).mapInArrow(_paths(base), PATHS)
        low = paths.filter(F.col("n") <= FAN**base) if base else None
        paths = materialize(down if low is None else down.unionByName(low.select(*down.columns)), "paths")
    return paths


def leaf_text(columns: list[Column]) -> Column:
    """What a leaf's digest is of: each value as byte count, colon, value; a null as a dash."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(*(part(c) for c in columns))


def merkle_proofs(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of ``docs``.

    A leaf is the SHA-256 of the row's columns. The leaves of a source stand by (id, leaf); of each
    level of more than one node, runs of 16 become a node. The roots of the sources, by source (null
    first, then by bytes), make the whole manifest's tree. The proof of a row is the siblings of its
    leaf and of its ancestors, level by level up to the root; ``folded_root`` goes up with them from
    the row's leaf, or from that of ``tampered`` (a text column that stands in for the text).

    Only ids and digests are shuffled, never texts. A builder or reader holds 4,096 nodes and one path.
    Null values have a mark of their own, so a null text is not an empty one; a null source is a
    source. Repeated rows have a leaf each; an empty table has no root and gives an empty result.
    Columns other than the five are not read.
    """
    key, source, text = columns[0], columns[1], columns[-1]
    of = lambda t: F.sha2(leaf_text([*(F.col(c) for c in columns[:-1]), t]), 256)
    leaf = of(F.col(text))
    changed = leaf if tampered is None else of(tampered)
    rows = docs.select(F.col(source).cast("string").alias("tree"), F.col(key).cast("long").alias("doc_id"), leaf.alias("digest"), changed.alias("changed"))
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed")))
    leaves = materialize(with_rank(rows, ["tree"], [F.col("doc_id"), F.col("digest"), F.col("changed")], "rank"), "leaves")
    log, most = build_log(leaves.select("tree", "rank", "digest"))

    subroots = log.filter("index = 0").groupBy("tree", "n").agg(F.max_by("digest", "level").alias("digest"))
    subroots = materialize(with_rank(subroots, [], [F.col("tree")], "place"), "subroots")
    forest, trees = build_log(subroots.select(F.lit("").alias("tree"), F.col("place").alias("rank"), "digest"))
    whole = forest.filter("index = 0").groupBy("n").agg(F.max_by("digest", "level").alias("root"))
    none = F.array().cast("array<struct<l:string,r:string>>")
    start = whole.select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("index"), none.alias("path"), F.lit(None).cast("string").alias("subroot"), "root", "n")
    places = node_paths(forest, trees, start)
    roots = subroots.join(places.select(F.col("index").alias("place"), "path", "root"), "place")
    paths = roots.select("tree", F.lit(0).cast("long").alias("index"), "path", F.col("digest").alias("subroot"), "root", "n")
    paths = node_paths(log, most, materialize(paths, "paths"), HEIGHT)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["tree", "chunk"]):
            found = group.to_pylist()
            head = found[0]
            segment = Segment([r for r in found if r["kind"] == 1], 0, head["n"])
            out = []
            for r in found:
                if r["kind"] < 2:
                    continue
                path = segment.siblings(r["rank"]) + head["path"]
                # A tree of one leaf has no level of its own.
                own = segment.at[position(0, r["rank"], head["n"])] if segment.end else head["subroot"]
                root = fold(r["changed"] or own, path)
                out.append((r["doc_id"], own, head["subroot"], head["root"], sha("".join(x["l"] + x["r"] for x in path)), root, root == head["root"]))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], PROOF_NAMES)

    joined = _segments(log, paths, 0, leaves)
    return joined.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


PROOF_NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
