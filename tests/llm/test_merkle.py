"""Merkle proofs against trees built by hand."""

import hashlib
import random

from pyspark.sql import functions as F

from fieldloom.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root, and for each node the siblings up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % 16 : k - k % 16 + 16]
            paths[i].append((run[: k % 16], run[k % 16 + 1 :]))
        nodes, at = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], paths


def expected(rows, change):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), leaf(change(r)), r[0]) for r in rows if r[1] == s), key=lambda x: x[:4])
        trees[s] = own, *climb([x[2] for x in own])
    root, above = climb([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        own, subroot, paths = trees[s]
        for (_, _, digest, changed, ident), path in zip(own, paths, strict=True):
            path, h = path + up, changed
            for left, right in path:
                h = sha("".join(left) + h + "".join(right))
            out.append((ident, digest, subroot, root, sha("".join("".join(a + b) for a, b in path)), h, h == root))
    return sorted(out, key=repr)


def made(n, sources, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, 3]), rnd.choice([None, "", "é", f"Text {i}", "A"])) for i in range(n)]


def check(spark, rows):
    change = lambda r: (*r[:4], r[4].lower() if r[4] is not None and r[0] is not None and r[0] % 3 == 0 else r[4])
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS rank", "'x' AS tree", "2 AS Digest")
    got = merkle.merkle_proofs(df, F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text")))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, change)


def test_proofs_of_sources_of_all_sizes(spark):
    rows = made(4500, ["big"]) + [(i + 5000, f"s{i % 40}", "en", 1, f"B{i}") for i in range(500)] + [(9000, None, None, None, None), (9001, "one", "x", 0, "Z"), (7, "s1", "en", 1, "twice"), (7, "s1", "en", 1, "twice"), (None, "s2", "en", 1, "No Id")]
    check(spark, rows)


def test_small_manifests(spark):
    check(spark, [(1, "a", "en", 1, "X")])
    check(spark, made(17, [None]))
    check(spark, made(33, ["a", "b", None]))
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.merkle_proofs(empty).count() == 0


def test_positions_are_a_postorder():
    for n in [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4097, 5000]:
        log = []

        def visit(level, index):
            if level:
                for i in range(index * 16, min(index * 16 + 16, -(-n // 16 ** (level - 1)))):  # noqa: B023
                    visit(level - 1, i)
            log.append((level, index))  # noqa: B023

        visit(merkle.top_level(n), 0)
        assert [merkle.position(level, i, n) for level, i in log] == list(range(len(log)))


def test_builders_write_in_completion_order():
    digests = [sha(str(i)) for i in range(300)]
    log = list(merkle.append_log(digests, 0, 0, 300))
    places = [merkle.position(level, i, 300) for level, i, _ in log]
    assert places == sorted(places) == list(range(len(log)))
    assert log[-1][2] == climb(digests)[0]
