"""Repeated passages: content-chosen windows bring repeats together, suffix arrays find them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gsaca import suffix_array
from .neardup import _groups
from .shared import discard, materialize, partitions, spare
from .textkit import U64, mix, utf8

GRAM = 64  #: bytes of an anchor
SEGMENT = 1 << 20  #: bytes looked at in one go; positions fit in 20 bits
CLASS = 4000  #: windows of one anchor in one suffix array
BATCH = 60_000  #: tokens of many small classes in one suffix array
WORDS = 8  #: words of an anchor of a stretch of words
WORD = re.compile(rb"[^\x09-\x0d ]+")
TOKEN = re.compile(rb"[^\x09-\x0d ]*[\x09-\x0d ]|[^\x09-\x0d ]+")
WINDOWS = "ah long, ch long, n long, k1 long, k2 long, pos long, left int, bytes binary"
SPANS = "ah long, ch long, spans array<struct<s:int,e:int>>"
SPAN_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


class Anchors:
    """Winnowing: of any ``length`` bytes, wherever they stand, the anchor is the first gram of smallest
    hash. Two equal strings of that length therefore have an anchor at the same offset, and every
    position at which ``length`` bytes start belongs to one anchor."""

    def __init__(self, length: int):
        self.length, self.window = length, length - GRAM + 1
        rng = np.random.default_rng(7)
        self.table = rng.integers(1, 2**64, 256, dtype=U64)
        base = int(rng.integers(1, 2**63)) * 2 + 1
        back = pow(base, -1, 2**64)
        up, down = [1], [1]
        for _ in range(SEGMENT + GRAM):
            up.append(up[-1] * base % 2**64)
            down.append(down[-1] * back % 2**64)
        self.up, self.down = np.array(up, U64), np.array(down, U64)

    def of(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: position, hash, and the first and last start that belong to it."""
        grams = len(text) - GRAM + 1
        if grams < self.window:
            none = np.empty(0, np.int64)
            return none, np.empty(0, U64), none, none
        found = []
        for start in range(0, grams - self.window + 1, SEGMENT - self.window + 1):
            part = text[start : min(start + SEGMENT, grams) + GRAM - 1]
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(self.table[part] * self.up[: len(part)], out=sums[1:])
            h = mix((sums[GRAM:] - sums[:-GRAM]) * self.down[: len(part) - GRAM + 1])
            low = U64(SEGMENT - 1)
            best = (h & ~low) | np.arange(len(h), dtype=U64)
            of = (_least(best, self.window) & low).astype(np.int64)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            last = np.r_[first[1:], len(of)] - 1
            at = of[first]
            found.append((at + start, h[at], first + start, last + start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]

    def of_words(self, text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for stretches of ``words`` whole words that take less than ``length`` bytes: of each run
        of them with one anchor, the first of smallest hash of their grams of words, where it begins and ends, and
        that hash. A run holds just these stretches, so its bytes tell them."""
        first, last = _words(text)
        n = len(first) - words + 1
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64))]
        low, at = U64(SEGMENT - 1), 0
        while at < n:
            base = first[at]
            to = max(at + 1, int(np.searchsorted(first[:n], base + SEGMENT - self.length)))
            s, e = first[at:to], last[at + words - 1 : to + words - 1]
            short = np.flatnonzero(e - s < self.length)
            if len(short):
                part = text[base : base + SEGMENT]
                sums = np.zeros(len(part) + 1, U64)
                np.cumsum(self.table[part] * self.up[: len(part)], out=sums[1:])
                # Grams that end beyond the part are in none of the short stretches.
                begin = np.minimum(first[at : to + words - WORDS] - base, len(part))
                end = np.minimum(last[at + WORDS - 1 : to + words - 1] - base, len(part))
                h = mix((sums[end] - sums[begin]) * self.down[begin])
                best = (h & ~low) | np.arange(len(h), dtype=U64)
                of = (_least(best, words - WORDS + 1) & low).astype(np.int64)[short]
                new = np.r_[True, (short[1:] != short[:-1] + 1) | (of[1:] != of[:-1])]
                found.append((s[short[new]], e[short[np.r_[new[1:], True]]], h[of[new]]))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _least(best: np.ndarray, window: int) -> np.ndarray:
    """The smallest of each ``window`` values in a row."""
    step = 1
    while step * 2 <= window:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    return np.minimum(best[: len(best) - (window - step)], best[window - step :]) if step < window else best


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    gap = np.r_[True, space[text], True]
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def _anchor_rows(length: int, words: int = 0):
    """Texts -> a row for each anchor. With ``words``, the last bit of an anchor's hash tells those of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            held, count = [], 0
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True):
                b = utf8(text.as_py())
                at, h, first, last = anchors.of(np.frombuffer(b, np.uint8))
                left, end = at - first, last + length
                if words:
                    begin, until, by_words = anchors.of_words(np.frombuffer(b, np.uint8), words)
                    at, first, end = np.r_[at, begin], np.r_[first, begin], np.r_[end, until]
                    left, h = np.r_[left, np.zeros_like(begin)], np.r_[h & ~U64(1), by_words | U64(1)]
                if not len(at):
                    continue
                ch = [xxhash.xxh3_64_intdigest(b[s:e], x) for s, e, x in zip(first.tolist(), end.tolist(), left.tolist(), strict=True)]
                held.append((h.view(np.int64), np.array(ch, U64).view(np.int64), np.full(len(at), k1), np.full(len(at), k2), at, left.astype(np.int32), (end - first).astype(np.int32)))
                count += len(at)
                if count > 50_000:
                    yield _batch(held, ["ah", "ch", "k1", "k2", "pos", "left", "size"])
                    held, count = [], 0
            if held:
                yield _batch(held, ["ah", "ch", "k1", "k2", "pos", "left", "size"])

    return run


def _batch(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


def _word_windows(words: int, below: int):
    """Texts -> a hash of each stretch of ``words`` whole words that takes less than ``below`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "k1", "k2", "pos", "size"]
        for batch in batches:
            held, count = [], 0
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True):
                b = utf8(text.as_py())
                first, last = _words(np.frombuffer(b, np.uint8))
                if len(first) < words:
                    continue
                s, e = first[: len(first) - words + 1], last[words - 1 :]
                dense = e - s < below
                s, e = s[dense], e[dense]
                for at in range(0, len(s), 50_000):
                    x, y = s[at : at + 50_000], e[at : at + 50_000]
                    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b[i:j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), np.int64).reshape(-1, 2)
                    held.append((h[:, 0], h[:, 1], np.full(len(x), k1), np.full(len(x), k2), x, (y - x).astype(np.int32)))
                    count += len(x)
                    if count > 50_000:
                        yield _batch(held, names)
                        held, count = [], 0
            if held:
                yield _batch(held, names)

    return run


def _cut_windows():
    """Documents with their wanted anchors -> the bytes around each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, wanted in zip(*(batch.column(c) for c in ("k1", "k2", "text", "wanted")), strict=True):
                b = utf8(text.as_py())
                rows = wanted.as_py()
                for at in range(0, len(rows), 5000):
                    part = rows[at : at + 5000]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([w["ah"] for w in part], pa.int64()),
                            pa.array([w["ch"] for w in part], pa.int64()),
                            pa.array([w["n"] for w in part], pa.int64()),
                            pa.array([k1.as_py()] * k, pa.int64()),
                            pa.array([k2.as_py()] * k, pa.int64()),
                            pa.array([w["pos"] for w in part], pa.int64()),
                            pa.array([w["left"] for w in part], pa.int32()),
                            pa.array([b[w["pos"] - w["left"] : w["pos"] - w["left"] + w["size"]] for w in part], pa.binary()),
                        ],
                        ["ah", "ch", "n", "k1", "k2", "pos", "left", "bytes"],
                    )

    return run


def repeated_starts(windows: list[tuple[int, int, int, tuple, int, bytes]], length: int) -> list[np.ndarray]:
    """For each window (class, copies, position, document, offset of its anchor, bytes): the offsets
    at or before the anchor at which ``length`` bytes start that also start elsewhere in its class.

    Tokens (up to a white-space byte, cut at the anchor too) are the symbols of one suffix array over
    all windows; a class's symbols are its own. Neighbours in it share the longest prefixes, so runs
    of neighbours that agree in ``length - l`` bytes from a token's start, and in the ``l`` bytes
    before it, are the repeats that start ``l`` bytes before that token.
    """
    found: list[list[np.ndarray]] = [[] for _ in windows]
    cut = [TOKEN.findall(b[:left]) + TOKEN.findall(b[left:]) for _, _, _, _, left, b in windows]
    rank = {t: i for i, t in enumerate(sorted({t for ts in cut for t in ts}))}
    classes: dict[int, int] = {}
    symbols, starts, before, owner = [], [], [], []
    base = 0
    for w, ((c, _, _, _, _, b), tokens) in enumerate(zip(windows, cut, strict=True)):
        shift = len(windows) + 1 + classes.setdefault(c, len(classes)) * len(rank)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        offsets = np.cumsum(sizes) - sizes
        symbols.append(np.fromiter(map(rank.__getitem__, tokens), np.int64, len(tokens)) + shift)
        symbols.append(np.array([len(windows) - w]))
        starts.append(np.r_[offsets, len(b)])
        # A start that is a token's here may lie inside one in another window, so it counts from the
        # next token as well.
        before.append(np.r_[1, sizes + 1])
        owner.append(np.full(len(tokens) + 1, w))
        base += len(b)
    symbols.append(np.zeros(1, np.int64))
    sa = np.array(suffix_array(np.concatenate(symbols)))[1:]
    w, t, back = np.concatenate(owner)[sa], np.concatenate(starts)[sa], np.concatenate(before)[sa]
    anchor = np.array([x[4] for x in windows])[w]
    size = np.array([len(x[5]) for x in windows])
    rem = size[w] - t
    use = (t <= anchor) & (rem > length - back)
    w, t, back, rem = w[use], t[use], back[use], rem[use]
    if len(w) == 0:
        return [np.empty(0, np.int64) for _ in windows]
    buffer = np.frombuffer(b"".join(x[5] for x in windows) + bytes(length), np.uint8)
    place = (np.cumsum(size) - size)[w] + t
    view = np.lib.stride_tricks.sliding_window_view(buffer, length)
    common = np.zeros(len(w) + 1, np.int64)
    for i in range(1, len(w), 4096):
        a, b = place[i - 1 : min(i + 4095, len(w) - 1)], place[i : i + 4096]
        differ = view[a] != view[b]
        got = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        common[i : i + len(got)] = got
    common[1:-1] = np.minimum(common[1:-1], np.minimum(rem[1:], rem[:-1]))
    cls = np.array([classes[x[0]] for x in windows])[w]
    common[1:-1][cls[1:] != cls[:-1]] = 0
    nearest = np.maximum(common[:-1], common[1:])
    many = np.array([x[1] > 1 for x in windows])[w]
    docs: dict[tuple, int] = {}
    where = np.array([docs.setdefault(x[3], len(docs)) * (1 << 40) + x[2] - x[4] for x in windows])[w] + t
    tail = np.zeros(len(w), U64)
    for n_before in range(int(back.max())):
        if n_before:
            tail = tail * U64(0x9E3779B97F4A7C15) + buffer[np.maximum(place - n_before, 0)] + U64(1)
        act = np.flatnonzero((back > n_before) & (nearest >= length - n_before) & (rem + n_before >= length) & (t >= n_before))
        if len(act) < 2:
            if not (back > n_before + 1).any():
                break
            continue
        run_id = np.cumsum(common[:-1] < length - n_before)[act]
        by = np.lexsort((where[act], tail[act], run_id))
        r, h, p, m, o = run_id[by], tail[act][by], where[act][by], many[act][by], act[by]
        heads = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
        lengths = np.diff(np.r_[heads, len(r)])
        good = (lengths > 1) & ((p[heads] != p[heads + lengths - 1]) | np.logical_or.reduceat(m, heads))
        for x in o[np.repeat(good, lengths)]:
            found[w[x]].append(t[x] - n_before)
    return [np.unique(np.array(x, np.int64)) for x in found]


def _covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    heads = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    ends = np.r_[starts[heads[1:] - 1], starts[-1]] + length
    return list(zip(starts[heads].tolist(), ends.tolist(), strict=True))


def _ranges(left: int, size: int, length: int, parts: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The starts of a window dealt over ``parts`` ranges that are the same for all windows of a class:
    number, first and last start it has there, first and last of the range, relative to the anchor."""
    reach = length - GRAM
    step = -(-(reach + 1) // parts)
    low, high = -left, size - left - length
    for k in range((low + reach) // step, (high + reach) // step + 1):
        first, last = k * step - reach, min(0, (k + 1) * step - 1 - reach)
        yield k, max(low, first), min(high, last), first, last


def _shared(rows: list[dict], length: int, parts: int = 4) -> list[dict]:
    """Windows of a class cut down to the starts whose range's core, the bytes that all strings from
    there hold, stands in another window too; without any, a window is dropped."""
    cores: dict[tuple[int, bytes], int] = {}
    own = []
    for r in rows:
        b, left = r["bytes"], r["left"]
        mine = [((k, b[last + left : first + left + length]), lo, hi) for k, lo, hi, first, last in _ranges(left, len(b), length, parts)]
        own.append(mine)
        for key, _, _ in mine:
            cores[key] = cores.get(key, 0) + 1
    out = []
    for r, mine in zip(rows, own, strict=True):
        good = [(lo, hi) for key, lo, hi in mine if cores[key] > 1]
        if good:
            lo, hi = good[0][0], good[-1][1]
            b, left = r["bytes"], r["left"]
            out.append(r | {"left": -lo, "bytes": b[lo + left : hi + left + length]})
    return out


def _stretches(b: bytes, words: int) -> list[tuple[bytes, int, int]]:
    """Hash, first and last of each stretch of ``words`` words."""
    at = [m.span() for m in WORD.finditer(b)]
    return [(xxhash.xxh3_128_digest(b[s:e]), s, e) for (s, _), (_, e) in zip(at, at[words - 1 :], strict=False)]


def _shared_words(rows: list[dict], words: int) -> Iterator[tuple[int, int, list[dict]]]:
    """Of a class of windows of words: those that stand once, and what else stands in the class of them."""
    own = [_stretches(r["bytes"], words) for r in rows]
    counts: dict[bytes, int] = {}
    for r, mine in zip(rows, own, strict=True):
        for h, _, _ in mine:
            counts[h] = counts.get(h, 0) + r["n"]
    for r, mine in zip(rows, own, strict=True):
        spans = [{"s": s, "e": e} for h, s, e in mine if counts[h] > 1]
        if r["n"] == 1 and spans:
            yield r["ah"], r["ch"], spans


def _hash_stretches(words: int):
    """Windows of words -> a row for each of their stretches; there are less than ``words`` a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), r["ah"], r["ch"], r["n"], s, e) for r in batch.to_pylist() for h, s, e in _stretches(r["bytes"], words)]
            types = [pa.int64()] * 5 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], ["h1", "h2", "ah", "ch", "n", "s", "e"])

    return run


def _search(length: int, words: int = 0):
    """Windows sorted by anchor -> for those that stand once, what their class repeats of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[dict]) -> pa.RecordBatch:
            starts = repeated_starts([(r["ah"], r["n"], r["pos"], (r["k1"], r["k2"]), r["left"], r["bytes"]) for r in held], length)
            out = [(r, _covered(s, length)) for r, s in zip(held, starts, strict=True) if r["n"] == 1 and len(s)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r["ah"] for r, _ in out], pa.int64()),
                    pa.array([r["ch"] for r, _ in out], pa.int64()),
                    pa.array([[{"s": a - r["left"], "e": b - r["left"]} for a, b in s] for r, s in out], SPAN_TYPE),
                ],
                ["ah", "ch", "spans"],
            )

        held, tokens, of_words = [], 0, []
        for group in _groups(batches, ["ah"]):
            rows = list({r["ch"]: r for r in group.to_pylist()}.values())
            if words and rows[0]["ah"] & 1:
                of_words += _shared_words(rows, words)
                if len(of_words) > 5000:
                    yield _span_batch(of_words)
                    of_words = []
                continue
            rows = _shared(rows, length) if len(rows) > 1 else []
            if len(rows) < 2:
                continue
            held += rows
            tokens += sum(r["bytes"].count(b" ") + 2 for r in rows)
            if tokens > BATCH:
                yield solve(held)
                held, tokens = [], 0
        if held:
            yield solve(held)
        if of_words:
            yield _span_batch(of_words)

    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    ah, ch, spans = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ah, pa.int64()), pa.array(ch, pa.int64()), pa.array(spans, SPAN_TYPE)], ["ah", "ch", "spans"])


def _narrowed(length: int, parts: int):
    """Windows of a class that is too large -> windows for ``parts`` ranges of starts each. All strings
    that start in a range share a core, which is the new anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ah", "ch", "n", "k1", "k2", "pos", "left", "bytes", "of_ah", "of_ch", "shift"]
        types = [pa.int64()] * 6 + [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                b, left = r["bytes"], r["left"]
                for k, lo, hi, first, last in _ranges(left, len(b), length, parts):
                    core = b[last + left : first + left + length]
                    piece = b[lo + left : hi + left + length]
                    key = xxhash.xxh3_64_intdigest(core + r["ah"].to_bytes(8, "little", signed=True), k)
                    out.append((signed(key), signed(xxhash.xxh3_64_intdigest(piece, last - lo)), r["n"], r["k1"], r["k2"], r["pos"] + last, last - lo, piece, r["ah"], r["ch"], last))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 11, types, strict=True)], names)

    return run


def _resolve(windows: DataFrame, classes: DataFrame, length: int, level: int, made: list[DataFrame], words: int = 0) -> DataFrame:
    """Windows (one for each anchor and content) -> spans relative to the anchor, for those with n = 1.

    ``classes(ah, m)``: the number of windows of each anchor. Stretches of ``words`` words are few in a window; in a
    class that is too large, they are brought together one by one. ``made`` takes the tables that are stored."""
    search = lambda df: df.repartition(partitions(df), "ah").sortWithinPartitions("ah").mapInArrow(_search(length, words), SPANS)
    if level == len(PARTS):
        return search(windows)
    windows = materialize(windows, "windows")  # at every size, so that the search can be repeated alone
    made.append(windows)
    hot = materialize(classes.filter(F.col("m") > CLASS).select("ah"), "hot")
    n_hot = hot.count()
    if not n_hot:
        return search(windows)
    key = F.broadcast(hot) if n_hot <= 100_000 else hot
    cold = search(windows.join(key, "ah", "left_anti"))
    schema = WINDOWS + ", of_ah long, of_ch long, shift int"
    large = windows.join(key, "ah", "left_semi")
    if words:
        by_words = F.col("ah").bitwiseAND(F.lit(1)) == 1
        each = large.filter(by_words).mapInArrow(_hash_stretches(words), "h1 long, h2 long, ah long, ch long, n long, s int, e int")
        each, large = materialize(each, "stretches"), large.filter(~by_words)
        made.append(each)
        twice = each.groupBy("h1", "h2").agg(F.sum("n").alias("m")).filter("m > 1").hint("merge")
        cold = cold.unionByName(each.filter("n = 1").join(twice, ["h1", "h2"], "left_semi").groupBy("ah", "ch").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    parts = materialize(large.mapInArrow(_narrowed(length, PARTS[level]), schema), "parts")
    one = parts.groupBy("ah", "ch").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "pos", "left", "bytes")).alias("r"))
    one = materialize(one.select("ah", "ch", "n", "r.*"), "parts")
    made += [hot, parts, one]
    whole = one.filter("n > 1").select("ah", "ch", F.array(F.struct((-F.col("left")).alias("s"), (F.length("bytes") - F.col("left")).cast("int").alias("e"))).alias("spans"))
    several = one.groupBy("ah").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("ah", "m")
    spans = whole.unionByName(_resolve(one.join(several, "ah", "left_semi"), several, length, level + 1, made))
    back = parts.select("ah", "ch", "of_ah", "of_ch", "shift").join(spans, ["ah", "ch"])
    back = back.select(F.col("of_ah").alias("ah"), F.col("of_ch").alias("ch"), F.transform("spans", lambda x: F.struct((x.s + F.col("shift")).alias("s"), (x.e + F.col("shift")).alias("e"))).alias("spans"))
    back = back.groupBy("ah", "ch").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most one a start
    ones = windows.filter("n = 1").select("ah", "ch")
    return cold.unionByName(back.join(ones, ["ah", "ch"], "left_semi"))


PARTS = (8, 400)  #: how finely classes that are too large are narrowed, at first and then


def _runs(rows: int, owner: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.ListArray:
    """Spans of ``rows`` texts, joined where they overlap or touch."""
    begin, end = owner * (1 << 40) + s, owner * (1 << 40) + e  # the spans of a text lie before those of the next
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    heads = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]]) if len(begin) else np.empty(0, np.int64)
    first, last = begin[heads], end[np.r_[heads[1:], len(begin)] - 1] if len(heads) else heads
    counts = np.bincount(first >> 40, minlength=rows)
    low = (1 << 40) - 1
    spans = pa.StructArray.from_arrays([pa.array((first & low).astype(np.int32)), pa.array((last & low).astype(np.int32))], fields=list(SPAN_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), spans)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts -> their maximal runs, without those of words and with them."""
    for batch in batches:
        pos, spans, w = batch.column("pieces").flatten().flatten()
        s, e = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.flatten().flatten())
        of = np.repeat(np.arange(len(pos)), spans.value_lengths().to_numpy(zero_copy_only=False))
        owner = np.repeat(np.arange(batch.num_rows), batch.column("pieces").value_lengths().to_numpy(zero_copy_only=False))[of]
        at, other = pos.to_numpy(zero_copy_only=False)[of], ~w.to_numpy(zero_copy_only=False)[of]
        all_of = _runs(batch.num_rows, owner, at + s, at + e)
        some = all_of if other.all() else _runs(batch.num_rows, owner[other], (at + s)[other], (at + e)[other])
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), some, all_of], ["k1", "k2", "spans", "passages"])


def find_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", name: str = "repeats", words: int = 0, apart: str = "") -> DataFrame:
    """``docs`` with ``repeats`` (or another ``name``), an array of (s, e): the maximal runs of UTF-8 bytes covered by strings
    of ``length`` bytes that also start anywhere else, in this document or another. Strings never
    cross documents, and are judged on the input.

    Winnowing chooses anchors so that both ends of every repeat hold one at the same offset. Anchors
    that stand once are dropped. Of the rest, the windows of ``length`` bytes around are brought
    together by anchor, equal windows as one; a window that stands more than once is repeated
    throughout, and the others' repeats are found by suffix arrays (``gsaca``). An anchor with very
    many different windows is narrowed to longer shared cores until each fits a task.

    With ``words``, stretches of that many whole words that start elsewhere too count as well, though
    they take less than ``length`` bytes; where words are that short, each stretch has a hash of its own.
    With ``apart`` as well, they are left out of ``name``, and a further column of that name has the runs of both.
    These are found by anchors of their own, grams of words, which costs little where most words are short.

    Null or short text: no repeats. Repeated rows are repeats of each other. An empty table gives an
    empty result. All columns of ``docs`` stay, but one that is called ``name``, in any case, is replaced.
    """
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    # The given columns travel as one, so that none can be taken for one of those below.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(whole, F.coalesce(ident, F.lit(-(2**63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    if apart and (words <= WORDS or apart.lower() == name.lower()):
        raise ValueError(f"apart takes stretches of more than {WORDS} words and a name of its own")
    anchored = words if apart else 0
    short = keyed.select("k1", "k2", "text")
    least = min(length, 2 * anchored - 1) if anchored else length
    rows = short.filter(F.octet_length("text") >= least).mapInArrow(_anchor_rows(length, anchored), "ah long, ch long, k1 long, k2 long, pos long, left int, size int")
    rows = materialize(rows, "anchors")
    # Counts per anchor and content come first, so that an anchor that stands very often is one row a
    # content in the joins that follow; all of these tables grow with the input.
    one = rows.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "left", "size")).alias("r"))
    one = materialize(one.select("ah", "ch", "n", "r.*"), "windows")
    several = one.groupBy("ah").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    whole = one.filter("n > 1").select("ah", "ch", F.array(F.struct((-F.col("left")).alias("s"), (F.col("size") - F.col("left")).alias("e"))).alias("spans"))
    several = materialize(several.filter("m > 1 and least = 1").select("ah", "m"), "classes")
    wanted = one.join(several.hint("merge"), "ah").groupBy("k1", "k2")
    wanted = wanted.agg(F.collect_list(F.struct("ah", "ch", "n", "pos", "left", "size")).alias("wanted"))
    # Of rows with equal id and text, one gives the windows; they lie side by side after the join.
    with_text = short.join(wanted.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    windows = with_text.mapInArrow(_cut_windows(), WINDOWS)
    made = [one, several]
    spans = materialize(whole.unionByName(_resolve(windows, several, length, 0, made, anchored)), "spans")
    discard(*made)
    of_words = F.col("ah").bitwiseAND(F.lit(1)) == 1 if anchored else F.lit(False)
    found = rows.join(spans.hint("merge"), ["ah", "ch"]).select("k1", "k2", "pos", "spans", of_words.alias("w"))
    if words and not apart:
        dense = materialize(short.mapInArrow(_word_windows(words, length), "h1 long, h2 long, k1 long, k2 long, pos long, size int"), "stretches")
        twice = dense.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
        again = dense.join(twice.hint("merge"), ["h1", "h2"], "left_semi").select("k1", "k2", "pos", (F.col("pos") + F.col("size")).alias("end"))
        # Stretches that touch are one, so a text in which many begin has few rows.
        of = Window.partitionBy("k1", "k2").orderBy("pos", "end")
        again = again.withColumn("before", F.max("end").over(of.rowsBetween(Window.unboundedPreceding, -1)))
        again = again.withColumn("island", F.count_if(F.col("before").isNull() | (F.col("pos") > F.col("before"))).over(of))
        again = again.groupBy("k1", "k2", "island").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
        found = found.unionByName(again.select("k1", "k2", "pos", F.array(F.struct(F.lit(0).alias("s"), (F.col("end") - F.col("pos")).cast("int").alias("e"))).alias("spans"), F.lit(False).alias("w")))
    pieces = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "spans", "w")).alias("pieces"))
    merged = pieces.mapInArrow(_merge, "k1 long, k2 long, spans array<struct<s:int,e:int>>, passages array<struct<s:int,e:int>>")
    out = keyed.select("row", "k1", "k2").join(merged.hint("merge"), ["k1", "k2"], "left")
    empty = F.array().cast("array<struct<s:int,e:int>>")
    more = [F.coalesce("passages", empty).alias(apart)] if apart else []
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in (name.lower(), apart.lower())), F.coalesce("spans", empty).alias(name), *more)


def kept_bytes(text: str | None, repeats: list) -> bytes:
    b, at, out = utf8(text), 0, []
    for x in repeats:
        out.append(b[at : x["s"]])
        at = x["e"]
    out.append(b[at:])
    return b"".join(out)


def kept_text(text: str | None, repeats: list) -> str | None:
    """The text without its repeats; a character of which a byte is cut goes whole, null stays null."""
    return text if not repeats or text is None else kept_bytes(text, repeats).decode("utf-8", "ignore")


def _of_words(text: str | None, repeats: list, least: int) -> list:
    """Those of the repeats that hold ``least`` words or more, words cut at their ends included."""
    if not least or not repeats:
        return repeats
    b = utf8(text)
    return [x for x in repeats if len(b[x["s"] : x["e"]].split()) >= least]


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", least_words: int = 0) -> DataFrame:
    """``docs`` with the repeats cut out of the text; a character of which a byte is cut goes whole.
    Repeats of fewer than ``least_words`` words stay, and those of as many whole words go, however few
    bytes they take. Null text stays null, an empty or short one as it
    is; repeated rows are repeats of each other; an empty table gives an empty result. All columns stay."""
    name = spare("repeats", docs.columns)
    found = find_repeats(docs, length, id_col, text_col, name, least_words)
    schema = found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(text_col).to_pylist(), batch.column(name).to_pylist(), strict=True)
            texts = [kept_text(t, _of_words(t, r, least_words)) for t, r in both]
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i).name, pa.array(texts, pa.string()))

    return found.mapInArrow(run, schema).drop(name)
