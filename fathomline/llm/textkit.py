"""Vectorised work on the text columns of Arrow batches.

A text column is read as one byte array with offsets. Words are found by a
256-entry byte table (``SEPARATOR``, which no UTF-8 text holds, else the byte to hash, A-Z lower-cased), and
each gets a 64-bit hash by prefix sums of a polynomial, so that the cost of a word
is a few numpy operations on its bytes. Equal words have equal hashes; where a
result hangs on equality, callers compare the words again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; arrays of 8 bytes a byte stay in cache.
SLICE_BYTES = 1 << 19


def _random_u64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=U64)


_BYTE_VALUES = _random_u64(11, 256)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
SHINGLE_MULT = _random_u64(12, 64) | U64(1)


#: What a table has for a byte between words.
SEPARATOR = 0xFF
SEPARATOR_BYTE = bytes([SEPARATOR])


def _byte_table(separators: Iterator[int]) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = SEPARATOR
    return table


#: Words of any characters but ASCII white space.
SPACE_WORDS = _byte_table(iter([0x20, *range(0x09, 0x0E)]))
#: Words of ASCII letters and digits and of all characters from U+0080 on.
ALNUM_WORDS = _byte_table(iter([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place where it can)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0], _POWERS[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte range."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words of some rows: hash, first and last byte, and for each row the range of its words."""

    __slots__ = ("hash", "start", "end", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        rows = offsets[:-1][offsets[:-1] < offsets[1:]]
        low = table[data]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = low != SEPARATOR
        begins = inside[1:-1] & ~inside[:-2]
        begins[rows] = inside[rows + 1]
        ends = inside[1:-1] & ~inside[2:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] = inside[last + 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = range_hashes(low, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words that begin at each word (also across rows)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out += hashes[j : j + n] * SHINGLE_MULT[j]
    return mix(out)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and n + 1 offsets.

    A row of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    counts = words.counts()
    every = window_hashes(words.hash, k)
    full = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    sizes = full + short
    offs = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    out = np.empty(offs[-1], U64)
    picked = np.repeat(words.first[:-1] - offs[:-1], full) if full.any() else np.zeros(0, np.int64)
    place = np.ones(offs[-1], bool)
    place[offs[:-1][short]] = False
    where = np.flatnonzero(place)
    out[where] = every[where + picked]
    for row in np.flatnonzero(short):
        a, b = words.first[row], words.first[row + 1]
        out[offs[row]] = window_hashes(words.hash[a:b], int(b - a))[0]
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    if len(out):
        fresh = np.empty(len(out), bool)
        fresh[0] = True
        np.not_equal(out[1:], out[:-1], out=fresh[1:])
        fresh[offs[:-1][sizes > 0]] = True
        ranks = np.zeros(len(out) + 1, np.int64)
        np.cumsum(fresh, out=ranks[1:])
        return out[fresh], ranks[offs]
    return out, offs


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of the values of each row; 0 for an empty row."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
