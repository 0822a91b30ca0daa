"""Vectorised splitting of Arrow text columns into words, shared by the Python operators.

Words are maximal runs of anything but ASCII white space (space, tab to carriage return).
Each distinct word of a slice is handled once; documents are lists of codes into that dictionary.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a Python worker.
SLICE_BYTES = 3 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about `limit` bytes of text each (one row at least). When the task ends, what
    the allocators keep is given back: a reused worker would hold it through the next stages."""
    try:
        yield from _cut(batches, column, limit)
    finally:
        release_memory()


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches until they have about `limit` bytes of text, then cuts as slices() does."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.concat_batches(held)

    def whole() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        for batch in batches:
            held.append(batch)
            size += batch.column(column).nbytes
            if size >= limit:
                yield joined()
                held, size = [], 0
        if held:
            yield joined()

    return slices(whole(), column, limit)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _cut(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(n) - n) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            # take copies: ascii_lower and others read a slice's offsets wrongly
            yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))


@dataclass
class Words:
    """offsets: int64[rows + 1] into codes; codes: int32 into dictionary (an Arrow string array)."""

    offsets: np.ndarray
    codes: np.ndarray
    dictionary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Splits texts (null: empty); lower folds A-Z only."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    dictionary = encoded.dictionary
    empty = pc.index(dictionary, pa.scalar("", dictionary.type)).as_py() if len(dictionary) else -1
    if empty >= 0:  # white space at an end of a text leaves empty words
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        codes = np.where(codes > empty, codes - 1, codes)
        dictionary = pa.concat_arrays([dictionary.slice(0, empty), dictionary.slice(empty + 1)])
    return Words(offsets, codes, dictionary)


def sum_rows(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] along the first axis, empty runs included."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def int_sum_rows(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def run_gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
