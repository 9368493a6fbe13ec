"""SentencePiece vocabularies: best-scoring segmentation by an Aho-Corasick automaton and Viterbi."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spare
from .tokens import WordTable, encode_all, public_path, together

SPACE = "▁"


class PieceTable(WordTable):
    """Segmentation of texts into the pieces of a model with the largest sum of scores.

    A text gets a space in front, as the model's normaliser has it, and each space is the model's space
    mark. No piece holds the mark after another character, so each run of spaces with what follows it
    is segmented alone. A mark that stands in the text itself is not a space: it goes as bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in normal}
        self.configure(pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(model.is_byte(i) for i in range(n)) else None, model.unk_id(), n)

    def configure(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, size: int) -> None:
        """``pieces``: text -> (id, score)."""
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space mark after another character")
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in pieces.items():
            self.automaton.add_word(p.replace(SPACE, " "), (len(p), score, i))
        self.automaton.make_automaton()
        self.single = {p.replace(SPACE, " ") for p in pieces if len(p) == 1}
        self.byte_ids, self.unknown = byte_ids, unknown
        self.penalty = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.bytes = [b""] * size
        for p, (i, _) in pieces.items():
            self.bytes[i] = p.replace(SPACE, " ").encode("utf-8")
        for b, i in enumerate(byte_ids or []):
            self.bytes[i] = bytes([b])
        lines = "" if any("\n" in p for p in pieces) else "\n"  # a character of no piece stands alone
        self.parts = re.compile(f"{lines}| *[^ {lines}]+| +" if lines else " *[^ ]+| +")
        self.reset()

    def words(self, text: str) -> list[str]:
        return self.parts.findall(" " + text)

    def segment(self, word: str) -> tuple[list[int], float]:
        """Single pass: the automaton gives all pieces that end at a position, the longest first, and
        each relaxes the best score there; of equal scores the first stays. A character that is no
        piece can be taken as its bytes, for less than any piece."""
        n = len(word)
        best = array("d", [-inf]) * (n + 1)  # 16 bytes a character, also where a text has no space
        length_of, piece_of = array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        done = 0

        def relax_unknown(upto: int) -> None:
            nonlocal done
            while done < upto:
                c = word[done]
                if c not in self.single and best[done] + self.penalty > best[done + 1]:
                    best[done + 1], length_of[done + 1], piece_of[done + 1] = best[done] + self.penalty, 1, -1
                done += 1

        for end, (length, score, i) in self.automaton.iter(word):
            if end > done:
                relax_unknown(end)
            s = best[end + 1 - length] + score
            if s > best[end + 1]:
                best[end + 1], length_of[end + 1], piece_of[end + 1] = s, length, i
        relax_unknown(n)
        ids: list[int] = []
        at = n
        while at > 0:
            i = piece_of[at]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown)
            at -= length_of[at]
        return ids[::-1], best[n]

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return together([self.segment(w)[0] for w in words])

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw else ""


@lru_cache(maxsize=1)
def piece_table(path: str | None) -> PieceTable:
    return PieceTable(path or public_path("piece_bpe_32k.model"))


class ByteTable:
    """Bytes of each piece, all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [b""] * model.get_piece_size()
        for i in range(len(self.bytes)):
            if model.is_byte(i):
                self.bytes[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = model.id_to_piece(i).replace(SPACE, " ").encode("utf-8")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw else ""


@lru_cache(maxsize=1)
def byte_table(path: str | None) -> ByteTable:
    return ByteTable(path or public_path("piece_bpe_32k.model"))


def encode_pieces(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` and ``pieces``, the ids of each whole text as
    little-endian 32-bit integers; with ``decoded`` also the text that these ids give back, made in
    the same pass (so that a task runs one Python worker, not two).

    The scores are the model's own, added up over the pieces; a vocabulary of merge ranks gives the
    segmentation of the best total rank. ``path``: None for the public 32k vocabulary.

    Null text stays null, an empty one has no pieces. Repeated rows each get their pieces; an empty
    table gives an empty result. A column that is called ``pieces`` (or ``decoded``), in any case, is
    replaced; all other names are free.
    """
    new = ["pieces", "decoded"] if decoded else ["pieces"]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    inner = spare("text", [*names, *new])
    source = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias(inner))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != inner] + ["pieces binary", "decoded string"][: len(new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(inner).to_pylist()
                ids = encode_all(table, texts)
                out = [pa.array([None if t is None else x.astype("<u4").tobytes() for t, x in zip(texts, ids, strict=True)], pa.binary())]
                if decoded:
                    out.append(pa.array([None if t is None else table.decode(x) for t, x in zip(texts, ids, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *out], [*names, *new])

    return source.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text that ``pieces`` stand for; null stays null, no pieces are the empty
    text, bytes that are no UTF-8 become replacement characters. Repeated rows and an empty table
    stay as they are; a column that is called ``decoded`` is replaced."""
    names = [c for c in encoded.columns if c.lower() != "decoded"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name.lower() != "decoded"] + ["decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [None if x is None else table.decode(np.frombuffer(x, "<u4")) for x in part.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)
