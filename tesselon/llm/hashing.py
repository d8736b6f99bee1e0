"""Word hashes and hashes of word ranges, over flat arrays of many documents."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes one worker keeps; beyond that it starts anew.
CACHE_WORDS = 150_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Ranges:
    """Hashes of ranges of a sequence of hashes: equal ranges have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.append(np.uint64(0), np.cumsum(values * powers(BASE, n), dtype=np.uint64))
        self.back = powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size``, by start."""
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n else np.empty(0, np.uint64)
