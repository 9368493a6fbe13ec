"""Token ids as binary blocks: static range asymmetric numeral system with one shared frequency table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, new_path, partitions
from .textkit import U64
from .tokens import encode_all, word_bpe

MAGIC = b"TKN1"
BITS = 20  #: frequencies add up to 2**BITS
LANES = 1024  #: interleaved states of a block
BLOCK = 1 << 20  #: tokens of a block
STEP = 256  #: rows of lanes between two checkpoints
LOW = U64(1 << 31)
HEAD = struct.Struct("<4sIQIIIII")  # magic, crc32 of the rest, table, tokens, lanes, words, checkpoints, documents
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<i8"), ("size", "<i8"), ("at", "<i8"), ("here", "<i8")])


class Table:
    """Frequencies of the symbols that occur, scaled to 2**BITS; every one has at least 1."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        n, total = len(self.symbols), max(1.0, counts.sum())
        if n > 1 << (BITS - 1):
            raise ValueError("too many symbols for the frequency table")
        share = 1 + np.floor(counts * ((1 << BITS) - n) / total).astype(np.int64)
        if n:
            rest = (1 << BITS) - int(share.sum())
            top = np.argsort(-counts, kind="stable")[: max(1, min(n, rest))]
            share[top] += rest // len(top)
            share[top[0]] += rest - rest // len(top) * len(top)
        self.freq, self.start = share.astype(U64), (np.cumsum(share) - share).astype(U64)
        self.slot = np.repeat(np.arange(n, dtype=np.int32), share)
        self.of = np.full(int(self.symbols[-1]) + 1 if n else 0, -1, np.int32)
        self.of[self.symbols] = np.arange(n)
        self.crc = zlib.crc32(self.symbols.tobytes() + share.tobytes())


def encode_block(ids: np.ndarray, table: Table, docs: np.ndarray, lanes: int = LANES, step: int = STEP) -> bytes:
    """One block: header, documents, checkpoints (word offset and the states of all lanes), words."""
    s = table.of[ids]
    f, c = table.freq[s], table.start[s]
    limit = f << U64(63 - BITS)
    n, rows = len(ids), -(-len(ids) // lanes)
    state = np.full(lanes, LOW, U64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    count = 0
    for t in range(rows - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x = state[: b - a]
        over = x >= limit[a:b]
        out = x[over]
        words.append((out & U64(0xFFFFFFFF)).astype("<u4"))
        count += len(out)
        x[over] = out >> U64(32)
        q, r = np.divmod(x, f[a:b])
        state[: b - a] = (q << U64(BITS)) + r + c[a:b]
        if t % step == 0:
            marks.append((count, state.astype("<u8")))
    words.reverse()
    marks.reverse()
    body = [docs.astype(DOC).tobytes()]
    body += [struct.pack("<I", count - done) + x.tobytes() for done, x in marks]
    body += [w.tobytes() for w in words]
    rest = b"".join(body)
    tail = HEAD.pack(MAGIC, 0, table.crc, n, lanes, count, len(marks), len(docs))[8:] + rest
    return MAGIC + struct.pack("<I", zlib.crc32(tail)) + tail


def open_block(block: bytes) -> tuple[tuple, np.ndarray]:
    """Header and documents; a wrong magic or checksum is an error."""
    head = HEAD.unpack_from(block)
    if head[0] != MAGIC or zlib.crc32(memoryview(block)[8:]) != head[1]:
        raise ValueError("damaged block")
    return head, np.frombuffer(block, DOC, head[7], HEAD.size)


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None, step: int = STEP) -> np.ndarray:
    """Ids of the block, or only those from checkpoint ``first`` to before checkpoint ``last``."""
    _, _, crc, n, lanes, n_words, n_marks, n_docs = open_block(block)[0]
    if crc != table.crc:
        raise ValueError("the block belongs to another frequency table")
    at = HEAD.size + n_docs * DOC.itemsize
    size = 4 + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, at + n_marks * size)
    last = n_marks if last is None else min(last, n_marks)
    if first >= last:
        return np.empty(0, np.uint32)
    (w,) = struct.unpack_from("<I", block, at + first * size)
    state = np.frombuffer(block, "<u8", lanes, at + first * size + 4).copy()
    begin, end = first * step * lanes, min(n, last * step * lanes)
    out = np.empty(end - begin, np.int32)
    mask, low = U64((1 << BITS) - 1), LOW
    for a in range(begin, end, lanes):
        b = min(n, a + lanes)
        x = state[: b - a]
        slot = x & mask
        s = table.slot[slot.astype(np.int64)]
        out[a - begin : b - begin] = s
        x = table.freq[s] * (x >> U64(BITS)) + slot - table.start[s]
        under = np.flatnonzero(x < low)
        x[under] = (x[under] << U64(32)) | words[w : w + len(under)]
        w += len(under)
        state[: b - a] = x
    return table.symbols[out].astype(np.uint32)


def _tokens(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, press = word_bpe(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in encode_all(table, part.column("text").to_pylist())]
                packed = [press.compress((x.astype("<u2") if x.max() < 65536 else x).tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "th", "n", "ids"],
                )

    return run


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=4 * n)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the row's number in its partition and the ids before it there."""
    row = before = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n"), batch.column("ids"), batch.column("part"), pa.array(np.arange(row, row + len(n))), pa.array(ends - n)],
            ["doc_id", "n", "ids", "part", "row", "before"],
        )
        row, before = row + len(n), int(ends[-1]) if len(n) else before


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # the counts of a document alone would take the vocabulary's length
            part = batch.slice(at, 256)
            c = np.bincount(np.concatenate([_unpack(data, n) for data, n in zip(part.column("ids").to_pylist(), part.column("n").to_pylist(), strict=True)]))
            if len(c) > len(total):
                total = np.r_[total, np.zeros(len(c) - len(total), np.int64)]
            total[: len(c)] += c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def _blocks(table: Table, offsets: dict[int, int]):
    """Consecutive rows of a partition -> blocks of about BLOCK ids; a longer document is divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size, last = [], [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal held, docs, size
            entries = np.array(docs, DOC)
            block = encode_block(np.concatenate(held), table, entries)
            first = int(entries["start"][0] + entries["at"][0])
            held, docs, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([block], pa.binary())], ["first", "block"])

        for batch in batches:
            for r in batch.to_pylist():
                if docs and (size >= BLOCK or last != (r["part"], r["row"] - 1)):
                    yield close()
                last = (r["part"], r["row"])
                ids, start = _unpack(r["ids"], r["n"]), offsets[r["part"]] + r["before"]
                for at in range(0, len(ids), BLOCK):
                    if at:
                        yield close()
                    piece = ids[at : at + BLOCK]
                    held.append(piece)
                    docs.append((r["doc_id"] or 0, r["doc_id"] is None, start, len(ids), at, len(piece)))
                    size += len(piece)
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of whole texts (null: none), each with ``end_id`` after it, in ascending
    ``doc_id`` order: ``out/blocks`` (first id's number, block) and ``out/table`` (id, frequency).

    Texts are encoded once and sorted by range; the counts of all ids make the shared table; then
    every partition cuts its rows into blocks that can be read alone. Rows that repeat an id follow
    each other by a hash of the text, null ids come first. An empty table gives empty files.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    tokens = source.mapInArrow(_tokens(path, end_id), "doc_id long, th long, n long, ids binary")
    tokens = materialize(tokens, "tokens")  # the range partitioning reads its input twice
    ranged = tokens.repartitionByRange(partitions(docs), "doc_id", "th").sortWithinPartitions("doc_id", "th").withColumn("part", F.spark_partition_id())
    numbered = ranged.mapInArrow(_numbered, "doc_id long, n long, ids binary, part int, row long, before long")
    numbered.write.option("compression", "uncompressed").parquet(f"{out}/sorted")  # the ids are packed
    rows = spark.read.parquet(f"{out}/sorted")

    counts = rows.select("n", "ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = counts.orderBy("id").collect()  # at most the vocabulary
    table = Table(np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64))
    frequencies = [(int(i), int(n)) for i, n in zip(table.symbols, (r[1] for r in counted), strict=True)]
    spark.createDataFrame(frequencies, "id long, n long").coalesce(1).write.parquet(f"{out}/table")

    sums = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a partition
    offsets, total = {}, 0
    for part, n in sums:
        offsets[part] = total
        total += n
    rows.mapInArrow(_blocks(table, offsets), "first long, block binary").write.option("compression", "uncompressed").parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, where: str) -> DataFrame:
    """``doc_id, start, n_tokens, at, ids`` of the files of ``write_tokens``: ids as little-endian
    32-bit integers; a document of more than a block comes in several rows, from ``at`` on."""
    counted = spark.read.parquet(f"{where}/table").orderBy("id").collect()  # at most the vocabulary
    table = Table(np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                data = block.as_py()
                _, docs = open_block(data)
                ids = decode_block(data, table).astype("<u4")
                ends = np.cumsum(docs["here"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs["doc_id"], mask=docs["null"].astype(bool)),
                        pa.array(docs["start"]),
                        pa.array(docs["size"]),
                        pa.array(docs["at"]),
                        pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, docs["here"], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "at", "ids"],
                )

    blocks = spark.read.schema("first long, block binary").parquet(f"{where}/blocks").select("block")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, at long, ids binary")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the rows of ``read_tokens``; a checksum is carried on
    over a document's pieces in order, one piece at a time."""

    def one(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("at")
        crc = 0
        for x in pieces["ids"]:
            crc = zlib.crc32(x, crc)
        return pd.DataFrame({"doc_id": pieces["doc_id"][:1], "start": pieces["start"][:1], "n_tokens": pieces["n_tokens"][:1], "ids_crc32": [crc]})

    whole = F.octet_length("ids") == 4 * F.col("n_tokens")
    short = tokens.select("doc_id", "start", "n_tokens", "at", F.when(whole, F.crc32("ids")).alias("ids_crc32"), F.when(~whole, F.col("ids")).alias("ids"))
    path = new_path(tokens.sparkSession, "read")
    short.write.parquet(path)
    rows = tokens.sparkSession.read.schema(short.schema).parquet(path)
    parts = rows.filter("ids_crc32 is null").groupBy("start").applyInPandas(one, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.filter("ids_crc32 is not null").select("doc_id", "start", "n_tokens", "ids_crc32").unionByName(parts)
