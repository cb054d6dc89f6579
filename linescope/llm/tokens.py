"""Token spans of whole batches of texts, and exact numbers for the tokens of a slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from linescope.llm.words import SPACE

#: Fixed values of the term rule: letters A-Z and a-z, and every code point beyond ASCII.
TERM = np.zeros(256, bool)
TERM[ord("A") : ord("Z") + 1] = TERM[ord("a") : ord("z") + 1] = TERM[0x80:] = True
WORD = ~SPACE


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the longest stretches of ``inside`` bytes that no row offset in ``at`` cuts.

    ``first`` holds rows + 1 offsets into the stretches.
    """
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at)


def strings(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The stretches as an Arrow array; no bytes are copied one by one."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    )


def numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of every value, distinct values): equal numbers are equal values."""
    held = column.dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary
