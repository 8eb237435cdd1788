"""Hashes of words and of runs of words, batch by batch, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_ENTRIES = 600_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words that were asked for; long words are not remembered, so the entries bound the bytes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_known = _Hashes()


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_known) > _ENTRIES:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * _ODD + h[i : i + n]
    return mix(total)
