"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Works on the UTF-8 bytes of an Arrow batch: A-Z are lower-cased, words are runs of bytes other than
space and 0x09-0x0D (bytes of longer characters are never among those). A shingle is five consecutive
words; a text of one to four words has one shingle, the whole sequence; a text without words has none.
Two different shingles get the same 64 bits with a chance of 2**-64, far below one in a corpus's pairs
that are compared; set sizes and overlaps are computed on these values.
"""

from __future__ import annotations

import numpy as np

WORDS = 5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    apart = _SEPARATOR[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first = np.ones(n, bool)
    first[1:] = apart[:-1]
    first[inner] = True
    last = np.ones(n, bool)
    last[:-1] = apart[1:]
    last[inner - 1] = True
    start = np.flatnonzero(first & ~apart)
    end = np.flatnonzero(last & ~apart) + 1
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * down[start]
    return mix(value ^ ((end - start).astype(np.uint64) * np.uint64(_BASE))), np.searchsorted(offsets, start, side="right") - 1


def grams(word: np.ndarray, row: np.ndarray, rows: int, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle, in order, repeated ones included."""
    count = np.bincount(row, minlength=rows)
    out, of = [], []
    if len(word) >= width:
        whole = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1])
        value = np.zeros(len(whole), np.uint64)
        for k in range(width):
            value = value * _GRAM + word[whole + k]
        out.append(mix(value + np.uint64(width)))
        of.append(row[whole])
    begin = np.cumsum(count) - count
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        value = np.zeros(len(short), np.uint64)
        for k in range(size):
            value = value * _GRAM + word[begin[short] + k]
        out.append(mix(value + np.uint64(size)))
        of.append(short)
    value, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return value[order], of[order]


def sets(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row in ascending order, one row after another, and each row's start (rows + 1)."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    return sets(*grams(*words(data, offsets), rows), rows)


def digests(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64 bits for each set, made from sum, exclusive or and size; 0 for an empty set."""
    size = np.diff(start)
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        a = np.add.reduceat(mix(value.copy()), start[some])
        b = np.bitwise_xor.reduceat(mix(value + np.uint64(_BASE)), start[some])
        out[some] = mix(mix(a) + b * _GRAM + size[some].astype(np.uint64))
    return out
