"""Whole-batch word hashing on Arrow string buffers.

A batch of texts is one byte buffer with row offsets, so words are found, lower-cased and hashed for all
rows at once. Batches are cut by bytes: memory is bounded by ``SLICE_BYTES`` or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: Fixed values of the word rule: white space is 0x20 and 0x09 to 0x0D, A-Z become a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; null is the empty text."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(
    column: pa.Array, size: int = SLICE_BYTES, most_rows: int = 1 << 16
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of about ``size`` bytes; a row is never cut."""
    data, at = _plain(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = int(np.searchsorted(at, at[first] + size, "right")) - 1
        end = min(max(end, first + 1), rows, first + most_rows)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


@dataclass
class Words:
    """Words of a slice: byte spans, lower-cased bytes, 64-bit hashes and the first word of every row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # rows + 1 offsets into the words


def words(data: np.ndarray, at: np.ndarray) -> Words:
    low = LOWER[data]
    inside = ~SPACE[low]
    n = len(low)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = ~inside[:-1] | edge[1:n]
        after[:-1] = ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(low, starts, ends, hashes, np.searchsorted(starts, at))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets) of the ``size``-word shingles in order.

    A row with fewer words gives its whole sequence as one shingle, a row without words none.
    """
    h, first = found.hashes, found.first
    counts = np.diff(first)
    n = len(h)
    total = np.zeros(n, np.uint64)
    rest = np.repeat(first[1:], counts) - np.arange(n)  # words from here to the end of the row
    for j in range(size):
        held = rest > j
        part = np.zeros(n, np.uint64)
        part[: max(n - j, 0)] = h[j:]
        total += np.where(held, mix(part + _U((j + 1) * int(_BASE) % (1 << 64))), _U(0))
    kept = (rest >= size) | ((np.repeat(counts, counts) < size) & (np.arange(n) == np.repeat(first[:-1], counts)))
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return mix(total[kept]), np.concatenate([[0], np.cumsum(made)])
