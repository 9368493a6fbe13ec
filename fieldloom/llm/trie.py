"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

Distinct conversations are sorted by their turns' digests over range partitions. In a block of them the
edges between neighbours, taken by descending length of the common prefix, join components; each join
is a branching node. Only prefixes of a block's first and last conversation can reach into another
block: everything below them is final and is contracted into numbers on these two paths, which are
the conversations of the next, much smaller forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neardup import _groups
from .shared import discard, materialize, partitions, with_rank

TURNS = 64  #: turns of a conversation that are compared at first
BLOCK = 20_000  #: conversations of a forest
IDS = 50_000  #: ids in a piece of a list of members
TAIL = 4096  #: turns in a stretch of running sums
NONE = hashlib.sha256(b"").hexdigest()

OWN = "array<struct<d:int,n:long,c:long,kids:long,leaves:long,saved:long,ident:string>>"
NODES = f"path array<binary>, sizes array<long>, own {OWN}, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ident string"


def turn_digest(role, text):
    """16 bytes of the SHA-256 of a turn."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), ``digest, size`` of each turn; rows without an id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return with_rank(rows.filter("conv_id IS NOT NULL"), ["conv_id"], [F.col("turn"), F.col("digest")], "pos").select("conv_id", "pos", "digest", "size")


def forked(turns: DataFrame) -> DataFrame:
    """Every conversation rebuilt: the first h turns of conversation c - c % 5, then its own from the
    (h + 1)-th on, h = crc32(c) % 9. ``conv_id, depth`` (from 1), ``digest, size``, and for each
    conversation a row of depth 0."""
    rows = materialize(ordered_turns(turns), "turns")
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 9
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    ids = sizes.select("conv_id", h.alias("h"), F.expr("conv_id - conv_id % 5").alias("base"))
    counts = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    ids = materialize(ids.join(counts.hint("merge"), "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "ids")
    own = rows.join(ids.select("conv_id", "h", "taken").hint("merge"), "conv_id").filter("pos >= h")
    out = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "size")
    head = rows.filter("pos < 8").withColumnRenamed("conv_id", "base").join(ids.select("conv_id", "base", "h").hint("merge"), "base").filter("pos < h")
    out = out.unionByName(head.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "size"))
    return out.unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size")))


def branching(lengths: list[int], common: list[int]) -> tuple[list[int], list[list[int]]]:
    """Depth and children of the nodes over sorted distinct sequences: node i < len(lengths) is the end
    of sequence i, further ones are branchings. ``common[i]``: the length of the prefix that i - 1 and i
    share. Edges by descending length join components, each known by its topmost node."""
    depth, kids = list(lengths), [[] for _ in lengths]
    up, top = list(range(len(lengths))), list(range(len(lengths)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in sorted(range(1, len(lengths)), key=lambda i: -common[i]):
        a, b, d = find(i - 1), find(i), common[i]
        if depth[top[a]] == d:  # of equal edges the left one comes first, so only the left node can be there
            kids[top[a]].append(top[b])
        else:
            depth.append(d)
            kids.append([top[a], top[b]])
            top[a] = len(depth) - 1
        up[b] = a
    return depth, kids


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _key(path: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(path), digest_size=16).digest()


def forest(items: list[dict], last: bool, keyed: bool) -> list[dict]:
    """Nodes of a block of sorted sequences (``path``, ``sizes``, ``own``: numbers that belong to a depth
    of the path), and its contracted first and last sequence; with ``last``, all nodes."""
    k = len(items)
    depth, kids = branching([len(x["path"]) for x in items], [0] + [_common(items[i - 1]["path"], items[i]["path"]) for i in range(1, k)])
    parent, rep = [-1] * len(depth), list(range(k)) + [0] * (len(depth) - k)
    order = sorted(range(len(depth)), key=lambda v: -depth[v])
    for v in order:
        for c in kids[v]:
            parent[c] = v
        if v >= k:
            rep[v] = rep[kids[v][0]]
    own: dict[tuple[int, int], list] = {}
    for i, x in enumerate(items):
        v = i
        for o in sorted(x["own"], key=lambda o: -o["d"]):
            while parent[v] >= 0 and depth[parent[v]] >= o["d"]:
                v = parent[v]
            own.setdefault((v, o["d"]), []).append(o)
    spine: dict[int, int] = {}  # node -> the item whose prefix it is
    if not last:
        for i in (0, k - 1):
            v = i
            while v >= 0 and v not in spine:
                spine[v] = i
                v = parent[v]
    big = 1 << 62
    whole: list[tuple] = [()] * len(depth)  # members, smallest, leaves, saved of each node's topmost prefix
    values: dict[int, list[tuple]] = {}
    carried: dict[int, list[dict]] = {0: [], k - 1: []}
    for v in order:
        above = depth[parent[v]] if parent[v] >= 0 else -1
        n, c, leaves, saved, children = 0, big, 0, 0, 0
        for x in kids[v]:
            if x not in spine:
                n, c, leaves, saved, children = n + whole[x][0], min(c, whole[x][1]), leaves + whole[x][2], saved + whole[x][3], children + 1
        rows = []
        for d in range(depth[v], above, -1):
            ident = None
            for o in own.get((v, d), ()):
                n, c, leaves, saved, children = n + o["n"], min(c, o["c"]), leaves + o["leaves"], saved + o["saved"], children + o["kids"]
                ident = ident or o["ident"]
            if v in spine:
                if n or children:
                    carried[spine[v]].append({"d": d, "n": n, "c": c, "kids": children, "leaves": leaves, "saved": saved, "ident": ident})
                n, c, leaves, saved, children = 0, big, 0, 0, 0
                continue
            leaves += not children
            saved += (n - 1) * (items[rep[v]]["sizes"][d - 1] if d else 0)
            rows.append((d, c, n, children, leaves, saved, ident))
            children = 1
        whole[v], values[v] = (n, c, leaves, saved), rows
    out = []
    for v in order:
        path = items[rep[v]]["path"]
        for j, (d, c, n, children, leaves, saved, ident) in enumerate(values[v]):
            up, up_key = None, None
            if j + 1 < len(values[v]):
                up = values[v][j + 1][1]
            elif parent[v] >= 0 and parent[v] in spine:
                up_key = _key(path[: d - 1])
            elif parent[v] >= 0:
                up = values[parent[v]][0][1]
            key = _key(path[:d]) if keyed else None
            out.append({"key": key, "parent_key": up_key, "depth": d, "conv_id": c, "parent_conv_id": up, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ident": ident})
    if not last:
        out += [{"path": items[i]["path"], "sizes": items[i]["sizes"], "own": carried[i]} for i in sorted({0, k - 1})]
    return out


_ITEM = pa.list_(pa.struct([("d", pa.int32()), *((c, pa.int64()) for c in ("n", "c", "kids", "leaves", "saved")), ("ident", pa.string())]))
_SCHEMA = pa.schema(
    [("path", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("own", _ITEM), ("key", pa.binary()), ("parent_key", pa.binary())]
    + [(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ident", pa.string())]
)


def _blocks(last: bool, keyed: bool, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(items: list[dict]) -> Iterator[pa.RecordBatch]:
            rows = forest(items, last, keyed)
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 5000], _SCHEMA)

        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= block and not last:
                yield from grown(held[:block])
                held = held[block:]
        if held:
            yield from grown(held)

    return run


def _sequences(turns: DataFrame, width: int) -> DataFrame:
    """``conv_id, n, ident, path, sizes, total``: the first ``width`` turns, and an identity of all."""
    some = lambda seed: F.coalesce(F.bit_xor(F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest"))), F.lit(0))
    rows = turns.groupBy("conv_id").agg(
        F.count("digest").alias("n"),
        F.concat_ws("-", F.count("digest"), F.hex(some(1)), F.hex(some(2))).alias("ident"),
        F.sort_array(F.collect_list(F.when(F.col("depth").between(1, width), F.struct("depth", "digest", "size")))).alias("t"),
        F.sum("size").alias("total"),
    )
    return rows.select("conv_id", "n", "ident", F.transform("t", lambda x: x.digest).alias("path"), F.transform("t", lambda x: x.size).alias("sizes"), "total")


def _ends(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``ident, ends_sha256`` of the members' ids in order. Lists of many ids come in pieces, which one
    task takes in one after another, as SHA-256 has to; it holds one piece at a time."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")
    many = materialize(texts.filter(F.col("m") > IDS).select("ident"), "many")
    if not many.count():
        return members.groupBy("ident").agg(F.sha2(listed("conv_id"), 256).alias("ends_sha256"))
    small = members.join(many.hint("merge"), "ident", "left_anti").groupBy("ident").agg(F.sha2(listed("conv_id"), 256).alias("ends_sha256"))
    ranked = with_rank(members.join(many.hint("merge"), "ident", "left_semi"), ["ident"], [F.col("conv_id")], "at")
    pieces = ranked.groupBy("ident", F.expr(f"at div {IDS}").alias("piece")).agg(listed("conv_id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for batch in batches:
            for ident, ids in zip(batch.column("ident").to_pylist(), batch.column("ids"), strict=True):
                if ident != last:
                    if h:
                        yield pa.RecordBatch.from_pydict({"ident": [last], "ends_sha256": [h.hexdigest()]})
                    last, h = ident, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py().encode())
        if h:
            yield pa.RecordBatch.from_pydict({"ident": [last], "ends_sha256": [h.hexdigest()]})

    pieces = pieces.repartition(partitions(members), "ident").sortWithinPartitions("ident", "piece")
    return small.unionByName(pieces.mapInArrow(run, "ident string, ends_sha256 string"))


def _tails(turns: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Nodes beyond the compared turns: chains, as no other conversation shares them."""
    long = texts.filter(F.col("n") > width).select(F.col("c").alias("conv_id"), "m", F.col("ident").alias("_ident"), "n")
    rows = turns.filter(F.col("depth") > width).join(long.hint("merge"), "conv_id").withColumn("_b", F.expr(f"depth div {TAIL}"))
    sums = rows.groupBy("conv_id", "_b").agg(F.sum("size").alias("_s"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "_b", F.coalesce(F.sum("_s").over(later), F.lit(0)).alias("_later"))
    within = Window.partitionBy("conv_id", "_b").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_w", F.sum("size").over(within)).join(sums.hint("merge"), ["conv_id", "_b"])
    end = F.col("depth") == F.col("n")
    return rows.select(
        "depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), F.col("m").alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("m") - 1) * (F.col("_w") + F.col("_later"))).alias("saved_tokens"), F.when(end, F.col("_ident")).alias("ident"),
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def conversation_trie(turns: DataFrame, width: int = TURNS) -> DataFrame:
    """The nodes of the prefix trie of ``turns(conv_id, depth, digest, size)``, depths gapless from 1 and a
    row of depth 0 for each conversation (its only one if it has no turns).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs`` (members), ``n_children, n_leaves``
    (childless nodes below, itself if it is one), ``saved_tokens`` ((members - 1) x size of the last turn,
    summed over the nodes below and itself), ``ends_sha256`` (of the ids that end here).

    Equal conversations are one sequence with a count, so a group of copies is no hot key. Of a sequence
    only as many turns are held in a row as different ones share (``width``, times 16 while too few);
    what follows is a chain and stays in rows of its own, so a conversation that holds a third of all
    turns is no large row. A block of 20,000 sequences is in memory at a time. Turns are equal if 128
    bits of their digests are. No conversations: no nodes, not even a root.
    """
    turns = materialize(turns.select("conv_id", "depth", "digest", "size"), "forked")
    while True:
        members = materialize(_sequences(turns, width), "sequences")
        texts = members.groupBy("ident").agg(F.count("*").alias("m"), F.min("conv_id").alias("c"), *(F.min_by(x, "conv_id").alias(x) for x in ("n", "path", "sizes", "total")))
        texts = materialize(texts, "texts")
        shared = texts.filter(F.col("n") >= width).groupBy(F.xxhash64("path")).count().filter("count > 1")
        if not shared.limit(1).count():
            break
        width *= 16
        discard(members)
        discard(texts)
    beyond = F.col("n") > width
    saved = (F.col("m") - 1) * (F.col("total") - F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    own = F.array(
        F.struct(
            F.size("path").alias("d"), F.col("m").alias("n"), "c", F.when(beyond, 1).otherwise(0).cast("long").alias("kids"), F.when(beyond, 1).otherwise(0).cast("long").alias("leaves"),
            F.when(beyond, saved).otherwise(0).cast("long").alias("saved"), F.when(~beyond, F.col("ident")).alias("ident"),
        )
    )
    items = texts.select("path", "sizes", own.alias("own"))
    made: list[DataFrame] = []
    while True:
        last = bool(made) and n_items <= BLOCK
        keyed = bool(made)
        # Beyond the first forest, as few tasks as fill their blocks, so that each forest is smaller.
        tasks = 1 if last else max(1, n_items // BLOCK) if made else partitions(items)
        spread = items.repartitionByRange(tasks, "path").sortWithinPartitions("path")
        grown = materialize(spread.mapInArrow(_blocks(last, keyed, BLOCK), NODES), "nodes")
        made.append(grown.filter("depth IS NOT NULL"))
        if last:
            break
        items = grown.filter("depth IS NULL").select("path", "sizes", "own")
        n_items = items.count()
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    upper = made[1]
    for more in made[2:]:
        upper = upper.unionByName(more)
    upper = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    # Few rows, two paths for each block, but they grow with the input.
    upper = F.broadcast(upper) if upper.count() <= 50_000 else upper.hint("merge")
    out = nodes.join(upper, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    out = out.select(*COLUMNS, "ident")
    if texts.filter(beyond).limit(1).count():
        out = out.unionByName(_tails(turns, texts, width).select(*COLUMNS, "ident"))
    ends = _ends(members.select("conv_id", "ident"), texts)
    ended = out.filter("ident IS NOT NULL").join(ends.hint("merge"), "ident").select(*COLUMNS, "ends_sha256")
    return ended.unionByName(out.filter("ident IS NULL").select(*COLUMNS, F.lit(NONE).alias("ends_sha256")))
