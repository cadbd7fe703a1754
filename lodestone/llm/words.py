"""Vectorised word and shingle hashes over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, np.bool_)
for _c in (*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)):
    _WORD[_c] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", P), ("down", INVERSE)):
            _powers[name] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base)]))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some rows, in order, and where each row's words begin (one more than rows).

    A word is a run of ASCII letters and digits and of bytes of non-ASCII characters; rows end words.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words within a row, and where each row's begin.

    A row of 1 to k-1 words has one shingle, of all its words; a row without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    if at[-1] == 0:
        return np.zeros(0, np.uint64), at
    where = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    length = np.repeat(np.minimum(counts, k), n)
    out = np.zeros(at[-1], np.uint64)
    for i in range(k):
        more = i < length
        out = np.where(more, out * np.uint64(0x100000001B3) + words[np.minimum(where + i, len(words) - 1)], out)
    return mix(out + length.astype(np.uint64)), at
