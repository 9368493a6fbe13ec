"""Token ids of whole texts with a public tokenizer, each distinct word encoded once a task."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa


def public_path(name: str) -> str:
    """Where a public vocabulary file lies; looked up on the machine that needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Ids of words, kept in flat arrays: of a list of words the ids come in a few array steps.

    The table is emptied when its words would take more than about ``LIMIT`` bytes, so that a worker's
    memory doesn't follow the vocabulary of the corpus.
    """

    LIMIT = 72 << 20
    ENTRY = 160  #: bytes of a short word's entry, besides its characters and ids

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.used, self.flat_used = 0, 0
        self.sizes, self.starts, self.flat = np.empty(1024, np.int64), np.empty(1024, np.int64), np.empty(4096, np.uint32)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        raise NotImplementedError

    def _add(self, words: set[str]) -> None:
        new = list(words)
        cost = sum(map(len, new)) + self.ENTRY * len(new)
        if self.used and self.used + cost > self.LIMIT:
            self.reset()
        ids, sizes = self.learn(new)
        n, m = len(self.index), self.flat_used
        self.sizes, self.starts = _room(self.sizes, n + len(new)), _room(self.starts, n + len(new))
        self.flat = _room(self.flat, m + len(ids))
        self.sizes[n : n + len(new)] = sizes
        self.starts[n : n + len(new)] = m + np.cumsum(sizes) - sizes
        self.flat[m : m + len(ids)] = ids
        self.index.update(zip(new, range(n, n + len(new)), strict=True))
        self.used, self.flat_used = self.used + cost + 4 * len(ids), m + len(ids)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, -1 for those that are not known."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def ids_and_ends(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in order, and where each word's ids end."""
        at = self._numbers(words)
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            missing = {words[i] for i in unknown}
            self._add(missing)
            if len(self.index) == len(missing):  # it was emptied: the known ones are needed again
                known = set(words).difference(self.index)
                if known:
                    limit, self.LIMIT = self.LIMIT, 1 << 62  # these words are needed together
                    self._add(known)
                    self.LIMIT = limit
                at = self._numbers(words)
            else:
                at[unknown] = self._numbers([words[i] for i in unknown])
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.uint32), ends
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1])], ends


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a copy with twice the room or more, if it has none for ``n`` entries."""
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def together(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and their sizes."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes


#: The pre-tokenizer's pattern with the letters, digits and spaces of Latin-1 spelled out.
_L, _N, _S = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
OTHER = re.compile("[^\x00-\xff]|<\\|")


class WordBpe(WordTable):
    """The tokenizers library on whole texts, word by word: its pre-tokenizer drops white space and no
    token spans it, so the ids of the words in order are the ids of the text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        super().__init__()

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that are one part to the pre-tokenizer and of printable ASCII, which its byte level leaves as
        it is, go to the library's model at once. Other words of one part are encoded together as one text: each
        ends with an id that carries the mark of a word's end. All others are encoded one by one."""
        kinds = np.fromiter(map(self._kind, words), np.int8, len(words))
        plain, parts, rest = ([w for w, k in zip(words, kinds.tolist(), strict=True) if k == kind] for kind in range(3))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if plain:
            tokenize = self.tokenizer.model.tokenize
            found.append(together([[t.id for t in tokenize(w)] for w in plain]))
        for at in range(0, len(parts), 200):
            some = parts[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                found.append(self._one_by_one(some))
            else:
                found.append((ids, np.diff(ends, prepend=0)))
        if rest:
            found.append(self._one_by_one(rest))
        flat, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(words) in (len(plain), len(parts), len(rest)):
            return flat, sizes
        order = np.argsort(np.argsort(kinds, kind="stable"))
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(len(flat))], sizes

    def _kind(self, word: str) -> int:
        """0: one part, of printable ASCII; 1: one part; 2: any other word."""
        if PARTS.fullmatch(word) is None or word != word.lower() or OTHER.search(word):
            return 2
        return 0 if word.isascii() and word.isprintable() else 1

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return together([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def words(self, text: str) -> list[str]:
        """Parts of a text that the tokenizer treats on their own.

        In Latin-1 text, where lower case and normal form are a character's own affair, they are what
        its pre-tokenizer makes of the lower-cased text; elsewhere they are what spaces set apart.
        """
        if not OTHER.search(text):
            return PARTS.findall(text.lower())
        return text.replace("\n", " ").replace("\t", " ").split(" ")


def slices(text: str, size: int = 1 << 20):
    """A text in parts of about ``size`` characters, cut at spaces only (the space goes)."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def encode_all(table: WordTable, texts: list[str | None], limit: int = 1 << 20) -> list[np.ndarray]:
    """Ids of each text (null: none). The words of about ``limit`` characters are looked up at once."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[str] = []
    of: list[tuple[int, int]] = []
    chars = 0

    def flush() -> None:
        ids, ends = table.ids_and_ends(held)
        at = first = 0
        for k, n in of:
            first += n
            end = int(ends[first - 1]) if first else 0
            out[k].append(ids[at:end])
            at = end
        held.clear()
        of.clear()

    for k, text in enumerate(texts):
        if not text:
            continue
        for part in slices(text) if len(text) > 2 * limit else (text,):
            words = table.words(part)
            held += words
            of.append((k, len(words)))
            chars += len(part)
            if chars > limit:
                flush()
                chars = 0
    flush()
    none = np.empty(0, np.uint32)
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]


@lru_cache(maxsize=1)
def word_bpe(path: str | None) -> WordBpe:
    """One table for all tasks of a Python worker. ``path``: None for the public word-BPE vocabulary."""
    return WordBpe(path or public_path("word_bpe_49k.json"))
