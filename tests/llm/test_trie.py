"""The conversation trie against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fieldloom.llm import trie


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, digest, role, text))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def nodes_of(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        term = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += term
            leaves[p[:d]] += p not in kids
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(conversations[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -8, 10**12]:
        for t in range(rnd.choice([0, 1, 2, 5, 9, 12])):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "é", "ok", "rice"])))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(14)]
    rows += [(None, 1, "user", "x"), rows[0], rows[0]]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,ids,width,tail", [(20_000, 50_000, 64, 4096), (3, 50_000, 64, 4096), (4, 2, 2, 3), (5, 3, 1, 2)])
def test_nodes_equal_dictionaries_of_prefixes(spark, monkeypatch, block, ids, width, tail):
    for name, value in (("BLOCK", block), ("IDS", ids), ("TAIL", tail)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations(block, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "'x' AS digest", "2 AS Depth")
    got = trie.conversation_trie(trie.forked(df), width)
    assert got.columns == [*trie.COLUMNS, "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == nodes_of(rebuilt(rows))


def test_long_conversations_and_shared_starts(spark, monkeypatch):
    monkeypatch.setattr(trie, "TAIL", 7)
    long = [("user", f"t{i}") for i in range(50)]
    made = {1: long, 2: long, 3: long[:30], 4: long[:40] + [("user", "other")], 5: [], 6: [("a", "b")]}
    rows = [(c, d + 1, hashlib.sha256(repr(x).encode()).digest()[:16], len(x[1])) for c, turns in made.items() for d, x in enumerate(turns)]
    df = spark.createDataFrame(rows + [(c, 0, None, 0) for c in made], "conv_id long, depth long, digest binary, size long")
    for width in (1, 16, 64):
        got = trie.conversation_trie(df, width)
        assert sorted(map(tuple, got.collect()), key=repr) == nodes_of(made)
    assert trie.conversation_trie(df.limit(0)).count() == 0


def test_branching_by_union_find():
    rnd = random.Random(2)
    for _ in range(100):
        texts = sorted({tuple(rnd.choices("ab", k=rnd.randint(0, 6))) for _ in range(rnd.randint(1, 12))})
        depth, kids = trie.branching([len(t) for t in texts], [0] + [trie._common(a, b) for a, b in zip(texts, texts[1:], strict=False)])
        prefixes = {t[:d] for t in texts for d in range(len(t) + 1)}
        several = {p for p in prefixes if sum((*p, x) in prefixes for x in "ab") > 1}
        assert sorted(depth) == sorted(len(p) for p in several | set(texts))
        assert all(depth[c] > depth[v] for v, x in enumerate(kids) for c in x)
