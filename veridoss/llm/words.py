"""Vectorised word and shingle hashing over whole Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lowered. Each
gets a 64-bit polynomial hash read off prefix sums, so no Python object is made per word.
Work goes in slices of about SLICE bytes, cut between documents or, in a long one,
between words; memory stays bounded whatever a text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


_TABLE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POW = _powers(_BASE, SLICE + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), SLICE + 1)


def _bounds(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; starts_at marks bytes where a document begins."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1] | starts_at[1:]
    last = word.copy()
    last[:-1] &= ~word[1:] | starts_at[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), U)
    i = 0
    while i < len(begin):
        base = begin[i]
        j = int(np.searchsorted(end, base + SLICE, "right"))
        if j <= i:  # one word longer than a slice
            word = data[begin[i] : end[i]].tobytes().lower()
            out[i] = U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
            i += 1
            continue
        part = data[base : end[j - 1]]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_TABLE[part] * _POW[: len(part)], out=sums[1:])
        b, e = begin[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[e] - sums[b]) * _INV[b] + (e - b).astype(U) * U(_BASE))
        i = j
    return out


def hashed(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first document, end document, word hashes, word offsets of those documents)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 4 * SLICE, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        flag = np.zeros(len(part) + 1, bool)
        flag[at] = True
        begin, end = _bounds(part, flag[:-1]) if len(part) else (np.zeros(0, np.int64),) * 2
        yield lo, hi, _hash(part, begin, end), np.searchsorted(begin, at)
        lo = hi


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words: the whole sequence as one."""
    if not len(words):
        return np.zeros(0, U)
    size = min(k, len(words))
    acc = np.full(len(words) - size + 1, U(size))
    for j in range(size):
        acc = (acc + words[j : len(words) - size + 1 + j]) * U(0xD6E8FEB86659FD93)
        acc ^= acc >> U(32)
    acc = mix(acc)
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]
