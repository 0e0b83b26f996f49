"""Helpers for counting words of whole texts in tasks, before anything is shuffled.

Texts are gathered to about ``GATHER`` bytes (a longer text is a gathering of its
own), so that equal words are counted together while memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textvec

GATHER = 12 << 20


def gathered(batches: Iterator[pa.RecordBatch], text: int = 0, size: int = GATHER) -> Iterator[pa.RecordBatch]:
    """Batches joined until their column ``text`` holds about ``size`` bytes."""
    held, total = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        total += b.column(text).nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of UTF-8 text as strings, A-Z in lower case."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    data = textvec.FOLD[buf[at]] if len(at) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ``keys`` in order, and the sums of ``values`` (counts without any) of each."""
    if not len(keys):
        return (keys, *(v[:0] for v in values or (np.zeros(0, np.int64),)))
    if not values:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[at], *(np.add.reduceat(v[order], at) for v in values))
