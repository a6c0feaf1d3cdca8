"""Words and their 64-bit hashes straight from UTF-8 bytes, a block of texts at a time.

Every word class here is a set of ASCII characters with or without all others. As the bytes of
a non-ASCII character are all 0x80 or more, working on bytes gives the same words as on characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.hashing import _MULTIPLIER, mix, weights


def byte_class(inside) -> np.ndarray:
    """A table of 256 flags from a test of one byte value."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Digits, letters and every character that is not ASCII.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Everything but the six ASCII white-space characters.
SOLID = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_CODES_LOWER = _BYTE_CODES[LOWER]
#: Bytes that ``find`` hashes at a time; it bounds the memory that a long text or word takes.
PIECE = 1 << 18


@dataclass
class Words:
    """Words of a block: byte places, the row each is of, and rows' first words (one more entry than rows)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def find(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of bytes of a class, none across texts, hashed after lower-casing A-Z if asked."""
    flag = inside[data]
    n = len(data)
    begin, last = flag.copy(), flag.copy()
    if n:
        begin[1:] &= ~flag[:-1]
        last[:-1] &= ~flag[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begin[edges] = flag[edges]
        last[edges - 1] = flag[edges - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(last) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    codes = _BYTE_CODES_LOWER if lower else _BYTE_CODES
    sums = np.zeros(len(start), np.uint64)
    for low in range(0, n if len(start) else 0, PIECE):
        high = min(low + PIECE, n)
        a, b = int(np.searchsorted(end, low, "right")), int(np.searchsorted(start, high))
        if a < b:
            size = np.minimum(end[a:b], high) - np.maximum(start[a:b], low)
            at = np.flatnonzero(flag[low:high])
            terms = codes[data[low:high][at]] * weights(at + low - np.repeat(start[a:b], size))
            sums[a:b] += np.add.reduceat(terms, np.cumsum(size) - size)
    return Words(start, end, row, first, mix(sums))


def word_hash(word: str) -> int:
    """The hash ``find`` gives to a word, lower-cased."""
    raw = np.frombuffer(word.encode(), np.uint8)
    terms = _BYTE_CODES_LOWER[raw] * weights(np.arange(len(raw)))
    return int(mix(np.add.reduce(terms, dtype=np.uint64)[None])[0])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of one row, with places: (hashes, index of each run's first word).

    A row with fewer than k words, but at least one, has its whole sequence as its only run.
    """
    n = len(words.hash)
    count = np.diff(words.first)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    left = np.repeat(words.first[1:], count) - np.arange(n)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        part = words.hash[np.minimum(np.arange(n) + j, n - 1)]
        acc = np.where(left > j, mix(acc * _MULTIPLIER + part + np.uint64(1)), acc)
    at_head = np.zeros(n, bool)
    at_head[words.first[:-1][count > 0]] = True
    keep = np.flatnonzero((left >= k) | at_head)
    return acc[keep], keep
