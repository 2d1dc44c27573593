"""Vectorised word hashes and word-shingle sets over Arrow string columns.

Words are runs of bytes outside space and 0x09-0x0D after A-Z became a-z. A word's hash is
a polynomial over a random byte table modulo 2**64, mixed; a shingle's hash combines its
words' hashes. Sets are sorted arrays of distinct 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from folioscan.llm.common import doc_groups, text_buffers

PIECE = 1 << 19
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream(256, 1)[LOWER]
_BASE = int(stream(1, 2)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = stream(64, 3) | _U(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            tables = [np.cumprod(np.concatenate([[_U(1)], np.full(max(n, PIECE), _U(b), _U)])) for b in (_BASE, _INVERSE)]
        _powers[:] = tables
    return _powers[0], _powers[1]


def _words_of_piece(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of data; cuts: positions at which a word always ends."""
    solid = ~SEPARATOR[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, _U)
        total[0] = 0
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        hashed = (total[end] - total[start]) * inverse[start]
        return mix(hashed + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15)), start


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the rows that offsets delimit in data."""
    low, high = int(offsets[0]), int(offsets[-1])
    hashes, starts = [], []
    while low < high:
        cut = min(low + PIECE, high)
        if cut < high:  # end the piece after a separator, or else where a row or the longer word ends
            back = np.flatnonzero(SEPARATOR[data[low:cut]])
            if len(back):
                cut = low + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(SEPARATOR[data[cut:high]])
                cut = cut + int(ahead[0]) + 1 if len(ahead) else high
        h, s = _words_of_piece(data[low:cut], offsets - low)
        hashes.append(h)
        starts.append(s + low)
        low = cut
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(offsets, start, "right") - 1


def power_sums(hashed: np.ndarray):
    """A function of (first, n): the hash of n words from the word `first` on, for arrays of both."""
    power, inverse = _power_tables(len(hashed))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(hashed * power[: len(hashed)], dtype=_U)])

    def span(first: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[first + n] - total[first]) * inverse[first] + np.asarray(n).astype(_U) * _U(0x9E3779B97F4A7C15))

    return span


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each row in order: the sorted distinct hashes of its word shingles.

    A row of fewer than `size` words has its whole sequence as its one shingle; a row
    without words (null, empty or blank text) has the empty set.
    """
    data, offsets = text_buffers(column)
    for i, j in doc_groups(offsets, PIECE):
        hashed, row = words(data, offsets[i : j + 1])
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(hashed) - size + 1), _U)
            for k in range(size):
                rolled += hashed[k : k + len(rolled)] * _STEP[k]
            rolled = mix(rolled)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= size:
                    yield np.unique(rolled[a : b - size + 1])
                elif b > a:
                    yield mix(np.array([(hashed[a:b] * _STEP[: b - a]).sum() + _U(b - a)], _U))
                else:
                    yield np.zeros(0, _U)
