"""Vectorised text helpers that run inside tasks: words, shingles, minima, fingerprints."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
MIX1, MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * MIX1
    x = x ^ (x >> U64(33))
    x = x * MIX2
    return x ^ (x >> U64(33))


class WordHashes(dict):
    """64-bit hash of each word, kept for the words seen so far (emptied when it grows too large)."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words in order; of the whole sequence if it is shorter."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, U64)
    width = min(k, n)
    out = np.full(n - width + 1, width, U64)
    for j in range(width):
        out = out * U64(0x9E3779B97F4A7C15) + mix(word_hashes[j : n - width + 1 + j] + U64(j + 1))
    return mix(out)


def shingle_set(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct ``k``-word shingles of the text with A-Z lower-cased; words are runs of
    anything but ASCII white space (what ``bytes.split`` and ``bytes.lower`` go by)."""
    return np.unique(shingles(cache.of(utf8(text).lower().split()), k))


def fingerprint(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


class MinHash:
    """``count`` multiply-add universal hashes of 32-bit keys; the minimum of each over a set."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**64, count, dtype=U64)[:, None] | U64(1)
        self.b = rng.integers(0, 2**64, count, dtype=U64)[:, None]

    def minima(self, values: np.ndarray) -> np.ndarray:
        keys = values >> U64(32)
        best = np.full(len(self.a), 2**64 - 1, U64)
        for i in range(0, len(keys), 1024):
            np.minimum(best, (self.a * keys[None, i : i + 1024] + self.b).min(axis=1), out=best)
        return (best >> U64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands) keys of 64 bits for (n, bands * rows) signatures."""
    n, count = signatures.shape
    parts = signatures.reshape(n, count // rows, rows).astype(U64)
    out = np.arange(1, count // rows + 1, dtype=U64)[None, :].repeat(n, 0)
    for j in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out


def runs(keys: np.ndarray) -> np.ndarray:
    """Offsets at which sorted ``keys`` change, with both ends."""
    if len(keys) == 0:
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.groups = n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.groups -= 1
        return True
