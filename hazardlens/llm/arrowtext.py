"""Text columns of Arrow batches as numpy byte buffers, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, so that temporaries of 8 bytes a byte stay in a core's cache; one longer text makes a
#: slice of its own.
SLICE_BYTES = 1 << 17


def byte_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)``; null texts are empty, offsets start at 0."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary()) if pa.types.is_binary(col.type) else col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    raw_offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null's bytes, if it has any, are skipped
        lengths = np.where(np.asarray(col.is_valid()), np.diff(raw_offsets), 0)
        if (lengths != np.diff(raw_offsets)).any():
            raw = np.concatenate([raw[a : a + k] for a, k in zip(raw_offsets[:-1], lengths, strict=True)])
            raw_offsets = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < n:
        last = int(np.searchsorted(raw_offsets, raw_offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        a, b = int(raw_offsets[first]), int(raw_offsets[last])
        yield first, last, raw[a:b], raw_offsets[first : last + 1] - a
        first = last


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable) -> object:
    """What an earlier task of this Python worker made for ``key``, or else ``make()``; ``tidy`` tasks of another key drop it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back(key: tuple | None = None) -> None:
    """Drops what is kept, but for ``key``, and gives the system what arrays and dropped objects took."""
    for k in [k for k in _kept if k != key]:
        del _kept[k]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def tidy(of: Callable, key: tuple | None = None) -> Callable:
    """``of`` for a reused Python worker: what its arrays took is given back to the system when the task ends.

    Of what earlier tasks have ``kept``, only what is under ``key`` stays.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(key)
        try:
            yield from of(batches)
        finally:
            give_back(key)

    return task
