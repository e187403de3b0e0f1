"""Word shingles of a text and their many universal hash minima."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

WORDS = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Most distinct words whose hashes a worker remembers.
CACHE_WORDS = 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; a shorter text is one shingle, one without words none.

    A-Z are lower-cased; words are stretches without space, tab, line feed, vertical tab, form feed and carriage return.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * MULTIPLIER + h[j : len(h) - n + 1 + j]
    return np.unique(mixed(out))


@functools.lru_cache(maxsize=4)
def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n fixed functions x -> a x + b over 32 bits, a odd."""
    draw = np.random.default_rng(20240117).integers(0, 1 << 32, size=(2, n), dtype=np.uint64).astype(np.uint32)
    return (draw[0] | np.uint32(1))[:, None], draw[1][:, None]


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each function over the set, in blocks that stay in cache."""
    a, b = universal(n)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512] * a + b).min(axis=1), out=low)
    return low


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
