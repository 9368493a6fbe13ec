"""Language-model scores by a weighted backoff automaton.

A corpus has more n-grams than a task can hold, so every bucket of texts (about 700,000 tokens) gets
the part of the automaton that its texts can reach. Counts and ids come level by level: the buckets ask
for their distinct words, then for the pairs (state, word) whose two shorter parts are states, and the
tasks that share these keys by hash add the counts up and answer each bucket in the order of its own
keys, so that no key travels back. With these answers a bucket builds its states and arcs, and walks
its texts once from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import _groups
from .shared import discard, materialize, partitions
from .textkit import U64, WordHashes, mix, utf8

BUCKET = 700_000  #: tokens of a bucket
STRETCH = 256  #: tokens of a text that one lane walks over
SHARE = 2_000_000  #: tokens for each task that adds up counts
PIECE = 4 << 20  #: bytes of a text that are split into words at a time
BEGIN, END = b"begin of text", b"end of text"  #: no words: words hold no space
MARGIN = 0.1  #: what the base adds to each count

PIECES = "bucket long, tokens binary, texts binary, words binary, n_tokens long, n_train long"
BLOCKS = "bucket long, level int, p int, a binary, b binary, c binary, n long"


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(b: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in stretches of about ``PIECE`` bytes, A-Z lower-cased."""
    b = utf8(text).lower()
    at = 0
    while len(b) - at > PIECE:
        end = at + PIECE
        while end < len(b) and b[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield b[at:end].split()
        at = end
    yield b[at:].split()


def _to_pieces(order: int):
    """Texts -> buckets of tokens. A text of several buckets goes on in the next one, which begins with
    the ``order - 1`` tokens before, so that each n-gram stands whole in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        begin, end = cache.of([BEGIN]), cache.of([END])
        number = TaskContext.get().partitionId() << 32
        row = number
        parts: list[np.ndarray] = []
        texts: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            meta = np.array(texts, np.int64)
            train = int(((meta[:, 4] - meta[:, 3]) * (meta[:, 1] & 2 == 0)).sum())
            out = [number, _pack(tokens.astype(np.uint32)), _pack(meta.ravel()), _pack(words), size, train]
            parts.clear()
            texts.clear()
            number, size = number + 1, 0
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds, strict=True)], ["bucket", "tokens", "texts", "words", "n_tokens", "n_train"])

        for batch in batches:
            for doc, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                flags = (doc is None) | held << 1
                before, fresh, begun = begin, [], 0
                for words in _words(text.as_py()):
                    fresh.append(cache.of(words))
                    while size + sum(map(len, fresh)) >= BUCKET:  # a long text goes on in the next bucket
                        now = np.concatenate(fresh)
                        now, rest = now[: max(1, BUCKET - size)], now[max(1, BUCKET - size) :]
                        parts.extend((before, now))
                        texts.append((doc or 0, flags | begun, row, len(before), len(before) + len(now)))
                        begun = 4
                        size += len(now)
                        before, fresh = np.concatenate([before, now])[-max(1, order - 1) :], [rest]
                        yield flush()
                last = np.concatenate([*fresh, end])
                parts.extend((before, last))
                texts.append((doc or 0, flags | begun, row, len(before), len(before) + len(last)))
                size += len(last)
                row += 1
        if texts:
            yield flush()

    return run


class Bucket:
    """The tokens of a bucket, with the ids and counts of all n-grams that were answered so far."""

    def __init__(self, tokens: bytes, texts: bytes, parts: int = 1):
        self.parts = parts
        self.t = _unpack(tokens, np.uint32).astype(np.int64)
        self.texts = _unpack(texts).reshape(-1, 5)
        ends = np.cumsum(self.texts[:, 4])
        self.starts = ends - self.texts[:, 4]
        self.ends, self.scored = ends, self.starts + self.texts[:, 3]
        at = np.arange(len(self.t))
        of = np.repeat(np.arange(len(ends)), self.texts[:, 4])
        self.first = at == self.starts[of]
        counted = (at >= self.scored[of]) | (self.first & (self.texts[of, 1] & 4 == 0))
        self.weight = (counted & (self.texts[of, 1] & 2 == 0)).astype(np.int64)
        self.levels: list[dict] = []

    def answered(self, ids: np.ndarray, counts: np.ndarray, gamma: np.ndarray) -> None:
        """Takes the answer to the next level's keys in their order."""
        local, rep = self.keys()[-2:] if self.levels else (self.t, None)
        known = np.r_[ids, 0][local] > 0  # a position without a key has the number -1
        self.levels.append({"local": np.where(known, local, -1), "ids": ids, "counts": counts, "gamma": gamma, "rep": rep})

    def keys(self) -> tuple:
        """The next level's distinct keys: state, word, training count and task of each, sorted by task;
        the key of each position (-1: none), and one position of each key."""
        words, last = self.levels[0], self.levels[-1]
        at = np.flatnonzero((last["local"][:-1] >= 0) & (last["local"][1:] >= 0) & ~self.first[1:]) + 1
        v = len(words["ids"])
        u, inverse = np.unique(last["local"][at - 1] * v + self.t[at], return_inverse=True)
        h, w = last["ids"][u // v], words["ids"][u % v]
        p = (mix(h.astype(U64) * U64(0x9E3779B97F4A7C15) + mix(w.astype(U64))) % U64(self.parts)).astype(np.int64)
        order = np.lexsort((h, p))  # words of a state stay in their order here
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        mine = rank[inverse]
        local = np.full(len(self.t), -1)
        local[at] = mine
        rep = np.zeros(len(u), np.int64)
        rep[mine] = at
        return h[order], w[order], np.bincount(mine, self.weight[at], len(u)).astype(np.int64), p[order], local, rep

    def scores(self, discount: float, n_train: int, n_words: int) -> tuple[list, list, list, list]:
        """Of each text: tokens, known tokens, base score, score."""
        v, top = len(self.levels[0]["ids"]), len(self.levels)
        count = self.levels[0]["counts"]
        base = np.log10((count + MARGIN) / (n_train + MARGIN * (n_words + 1)))
        shift = np.cumsum([1, *(len(x["ids"]) for x in self.levels)])
        # A state is a kept n-gram of fewer than `top` words; 0 is the empty one, which has an arc for every word.
        state = lambda j, local: int(shift[j]) + local
        first = np.where((self.levels[0]["ids"] > 0) & (top > 1), state(0, np.arange(v)), 0)
        keys, to, gain = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        fail, fall = [np.zeros(1 + v, np.int64)], [np.r_[0.0, np.log10(self.levels[0]["gamma"]) if top > 1 else np.zeros(v)]]
        chance = 10.0**base
        for j in range(1, top):
            low, x = self.levels[j - 1], self.levels[j]
            kept = np.flatnonzero(x["ids"] > 0)
            rep = x["rep"][kept]
            head, tail = low["local"][rep - 1], low["local"][rep]
            here = np.zeros(len(x["ids"]))
            here[kept] = (x["counts"][kept] - discount) / low["counts"][head] + low["gamma"][head] * chance[tail]
            keys.append(state(j - 1, head) * v + self.t[rep])
            gain.append(np.log10(here[kept]))
            if j < top - 1:
                to.append(state(j, kept))
                down, weight = np.zeros(len(x["ids"]), np.int64), np.zeros(len(x["ids"]))
                down[kept], weight[kept] = state(j - 1, tail), np.log10(x["gamma"][kept])
                fail.append(down)
                fall.append(weight)
            else:
                to.append(state(j - 1, tail))
            chance = here
        keys, to, gain = (np.concatenate(c) for c in (keys, to, gain))
        order = np.argsort(keys)
        total = self.walk(keys[order], to[order], gain[order], np.concatenate(fail), np.concatenate(fall), first, base, top)
        of = np.repeat(np.arange(len(self.ends)), self.ends - self.scored)
        at = np.concatenate([np.arange(a, e) for a, e in zip(self.scored.tolist(), self.ends.tolist(), strict=True)]) if len(of) else of
        n_known, base_score = (np.bincount(of, c[self.t[at]], len(self.ends)) for c in (count > 0, base))
        return (self.ends - self.scored).tolist(), n_known.astype(np.int64).tolist(), base_score.tolist(), total.tolist()

    def walk(self, keys, to, gain, fail, fall, first, base, top: int) -> np.ndarray:
        """One pass from left to right over all texts side by side, each carrying its state: where a
        state has no arc for the next word, its failure arc is taken and weighed until one has.

        Texts are cut into stretches, so that they are of like length. A stretch begins in the empty
        state with the ``top - 1`` tokens before it, whose weights don't count: they lead to the state
        that the walk up to there is in, for a state is its last tokens."""
        spans = []
        for i, (s, a, e) in enumerate(zip(self.starts.tolist(), self.scored.tolist(), self.ends.tolist(), strict=True)):
            spans += [(i, max(s, x - max(1, top - 1)), x, min(x + STRETCH, e)) for x in range(a, e, STRETCH)]
        total = np.zeros(len(self.ends))
        if not spans:
            return total
        text, begin, since, end = np.array(spans, np.int64).T
        order = np.argsort(begin - end, kind="stable")  # the longest first: those still under way are a prefix
        text, begin, since, size = text[order], begin[order], since[order], (end - begin)[order]
        now, sums = np.zeros(len(text), np.int64), np.zeros(len(text))
        v = len(base)
        for step in range(int(size[0])):
            m = int(np.searchsorted(-size, -step))
            at = begin[:m] + step
            w, s, counts = self.t[at], now[:m], at >= since[:m]
            weight, nexts = np.zeros(m), np.zeros(m, np.int64)
            left = np.arange(m)
            while len(left):
                here, word = s[left], w[left]
                root = here == 0
                done = left[root]
                weight[done] += base[word[root]]
                nexts[done] = first[word[root]]
                left, here, word = left[~root], here[~root], word[~root]
                if not len(left):
                    break
                i = np.searchsorted(keys, here * v + word)
                hit = np.zeros(len(left), bool)
                inside = i < len(keys)
                hit[inside] = keys[i[inside]] == (here * v + word)[inside]
                weight[left[hit]] += gain[i[hit]]
                nexts[left[hit]] = to[i[hit]]
                left, here = left[~hit], here[~hit]
                weight[left] += fall[here]
                s[left] = fail[here]
            now[:m] = nexts
            sums[:m] += np.where(counts, weight, 0.0)
        return np.bincount(text, sums, len(self.ends))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _cuts(p: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.r_[np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(p)] if len(p) else np.zeros(1, np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(p[a]), a, b


def _ask_words(parts: int):
    """Buckets -> their words with training counts, a block for each task. A word's task rises with its
    hash, so the blocks in order of their tasks hold the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, b = _unpack(r["words"], U64), Bucket(r["tokens"], r["texts"])
                count = np.bincount(b.t, b.weight, len(words)).astype(np.int64)
                p = ((words >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
                yield _batch(BLOCKS, [(r["bucket"], 1, q, _pack(words[s:e]), None, _pack(count[s:e]), e - s) for q, s, e in _cuts(p)])

    return run


def _add_words(parts: int):
    """Blocks sorted by task -> ids (0: not in training) and counts for each block, and a row with the
    number of words in training."""
    begin = WordHashes()[BEGIN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["p"]):
            rows = group.to_pylist()
            keys = [_unpack(r["a"], U64) for r in rows]
            u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([_unpack(r["c"]) for r in rows]), len(u)).astype(np.int64)
            p, at = rows[0]["p"], 0
            ids = np.where(count > 0, np.cumsum(count > 0) * parts + p, 0)
            out = [(-1, 1, p, None, None, None, int((count[u != U64(begin)] > 0).sum()))]
            for r, k in zip(rows, keys, strict=True):
                mine = inverse[at : at + len(k)]
                at += len(k)
                out.append((r["bucket"], 1, p, _pack(ids[mine]), _pack(count[mine]), None, len(k)))
            yield _batch(BLOCKS, out)

    return run


def _add_pairs(level: int, parts: int, least: int, last: bool):
    """Blocks sorted by task -> ids (0: seen less than ``least`` times; none on the last level, where they are
    no states) and counts for each block, and for each task of the states the sum and number of their
    kept continuations (bucket below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["p"]):
            rows = group.to_pylist()
            hs, ws = [_unpack(r["a"]) for r in rows], [_unpack(r["b"]) for r in rows]
            hu, hi = np.unique(np.concatenate(hs), return_inverse=True)
            wu, wi = np.unique(np.concatenate(ws), return_inverse=True)
            u, inverse = np.unique(hi * len(wu) + wi, return_inverse=True)
            count = np.bincount(inverse, np.concatenate([_unpack(r["c"]) for r in rows]), len(u)).astype(np.int64)
            kept = count >= least
            p, at = rows[0]["p"], 0
            ids = np.where(kept, np.cumsum(kept) * parts + p, 0)
            out = []
            for r, k in zip(rows, hs, strict=True):
                mine = inverse[at : at + len(k)]
                at += len(k)
                out.append((r["bucket"], level, p, None if last else _pack(ids[mine]), _pack(np.where(kept[mine], count[mine], 0)), None, len(k)))
            own, of = np.unique(u[kept] // len(wu), return_inverse=True)
            mass, kinds = np.bincount(of, count[kept], len(own)).astype(np.int64), np.bincount(of, minlength=len(own))
            goal = hu[own] % parts
            order = np.lexsort((hu[own], goal))
            h, mass, kinds = hu[own][order], mass[order], kinds[order]
            out += [(-1 - p, level, q, _pack(h[s:e]), _pack(mass[s:e]), _pack(kinds[s:e]), e - s) for q, s, e in _cuts(goal[order])]
            yield _batch(BLOCKS, out)

    return run


def _weigh():
    """Answers of a level and the sums for its states, sorted by task and bucket -> the answers with the
    sum and number of each state's kept continuations, of which its failure arc's weight is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["p"]):
            rows = group.to_pylist()
            sums = [r for r in rows if r["bucket"] < 0]
            if sums:
                h, of = np.unique(np.concatenate([_unpack(r["a"]) for r in sums]), return_inverse=True)
                mass = np.bincount(of, np.concatenate([_unpack(r["b"]) for r in sums]), len(h))
                kinds = np.bincount(of, np.concatenate([_unpack(r["c"]) for r in sums]), len(h))
            out = []
            for r in rows:
                if r["bucket"] < 0:
                    continue
                ids = _unpack(r["a"])
                own = np.zeros((2, len(ids)), np.int64)
                if sums:
                    i = np.minimum(np.searchsorted(h, ids), len(h) - 1)
                    has = (h[i] == ids) & (ids > 0)
                    own[:, has] = mass[i[has]], kinds[i[has]]
                out.append((r["bucket"], r["level"], r["p"], r["a"], r["b"], _pack(own.ravel()), r["n"]))
            yield _batch(BLOCKS, out)

    return run


def _read(batches: Iterator[pa.RecordBatch], parts: int, levels: int, discount: float = 0.0) -> Iterator[tuple[int, Bucket]]:
    """Buckets with the answers to ``levels`` levels, from rows sorted by bucket, level and task."""
    for group in _groups(batches, ["bucket"]):
        rows = group.to_pylist()
        bucket = Bucket(rows[0]["a"], rows[0]["b"], parts)
        for level in range(1, levels + 1):
            own = [r for r in rows if r["level"] == level]
            each = lambda c: [_unpack(r[c]) for r in own if r[c] is not None]  # noqa: B023, E731
            join = lambda x: np.concatenate([np.empty(0, np.int64), *x])
            counts, ids = join(each("b")), join(each("a"))
            sums = [x.reshape(2, -1) for x in each("c")]
            mass, kinds = (join([x[k] for x in sums]) for k in (0, 1))
            gamma = np.ones(len(mass))
            gamma[kinds > 0] = ((counts[: len(mass)] - mass + discount * kinds) / np.maximum(1, counts[: len(mass)]))[kinds > 0]
            bucket.answered(ids if len(ids) == len(counts) else (counts > 0).astype(np.int64), counts, gamma)
        yield rows[0]["bucket"], bucket


def _ask_pairs(level: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in _read(batches, parts, level - 1):
            h, w, count, p, _, _ = b.keys()
            yield _batch(BLOCKS, [(number, level, q, _pack(h[s:e]), _pack(w[s:e]), _pack(count[s:e]), e - s) for q, s, e in _cuts(p)])

    return run


SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, discount: float, parts: int, n_train: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _read(batches, parts, order, discount):
            doc = [None if f & 1 else d for d, f in b.texts[:, :2].tolist()]
            held = (b.texts[:, 1] & 2 > 0).tolist()
            yield _batch(SCORES, list(zip(b.texts[:, 2].tolist(), doc, held, *b.scores(discount, n_train, n_words), strict=True)))

    return run


def backoff_scores(docs: DataFrame, order: int = 2, discount: float = 0.75, least: int = 2, fold: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``.

    Tokens are the words of the text (A-Z lower-cased) and one end. Texts whose crc32(id) divides by
    ``fold`` are held out; the n-grams up to ``order`` of the others are counted. The distribution of
    single words is the base: (c + 0.1) / (N + 0.1 (V + 1)), an unknown word counting as one more. An
    n-gram hw of two words or more is a state if it was seen ``least`` times; with its shorter h' it has

        P(w | h) = (c(hw) - discount) / c(h) + g(h) P(w | h'),   else   P(w | h) = g(h) P(w | h'),

    where g(h), the weight of the failure arc from h to h', is what the kept n-grams leave of 1, so the
    chances of all words after any state add up to 1. The text's begin is a state, not a token.

    Buckets of 700,000 tokens hold a long text in parts that go on where the last one ended; words
    and states are shared out by hash, each bucket asking once for each, so frequent ones are no hot
    keys. All counts cover all texts. Null text: empty, one token. A null id is not held out. Repeated
    rows are scored (and counted) one by one; an empty table gives an empty result. Other columns are
    not read. Without training texts every chance is 1. Scores of texts over several buckets are added
    up in no fixed order.
    """
    if order < 1 or least < 1 or not 0 < discount < 1:
        raise ValueError("order and least must be positive, discount between 0 and 1")
    ident = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(F.encode(ident.cast("string"), "UTF-8")) % fold == 0, F.lit(False))
    rows = docs.select(ident.alias("doc_id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(_to_pieces(order), PIECES), "pieces")
    total, n_train, buckets = pieces.agg(F.sum("n_tokens"), F.sum("n_train"), F.count("*")).first()
    parts, tasks = max(partitions(docs), -(-(total or 0) // SHARE)), max(partitions(docs), buckets // 2)
    by_task = lambda df: df.repartition(parts, "p").sortWithinPartitions("p", "bucket")

    def by_bucket(answers: list[DataFrame]) -> DataFrame:
        out = pieces.selectExpr("bucket", "0 AS level", "0 AS p", "tokens AS a", "texts AS b", "CAST(NULL AS BINARY) AS c", "n_tokens AS n")
        for x in answers:
            out = out.unionByName(x.filter("bucket >= 0"))
        return out.repartition(tasks, "bucket").sortWithinPartitions("bucket", "level", "p")

    asked = pieces.select("bucket", "tokens", "texts", "words").mapInArrow(_ask_words(parts), BLOCKS)
    last = materialize(by_task(asked).mapInArrow(_add_words(parts), BLOCKS), "words")
    n_words = last.filter("bucket < 0").agg(F.sum("n")).first()[0] or 0
    done: list[DataFrame] = []
    for level in range(2, order + 1):
        asked = by_bucket([*done, last]).mapInArrow(_ask_pairs(level, parts), BLOCKS)
        pairs = materialize(by_task(asked).mapInArrow(_add_pairs(level, parts, least, level == order), BLOCKS), "pairs")
        both = last.filter("bucket >= 0").unionByName(pairs.filter("bucket < 0"))
        done.append(materialize(by_task(both).mapInArrow(_weigh(), BLOCKS), "states"))
        discard(last)  # its answers are among the states'
        last = pairs
    scored = by_bucket([*done, last]).mapInArrow(_score(order, discount, parts, n_train or 0, n_words), SCORES)
    whole = scored.groupBy("row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "held_out")), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train or 0).cast("long").alias("train_tokens"), "base_score", "score")
