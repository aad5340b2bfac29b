"""Word shingles as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def word_numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_numbers(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A number for each ``width`` consecutive words; fewer words make one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out = _mixed(out + words[i : n - width + 1 + i])
    return out


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle numbers of a text; none for a null or blank one."""
    return np.unique(shingle_numbers(word_numbers(words_of(text or b""))))
