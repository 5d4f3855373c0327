"""Vectorised word kernel over Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8
continuation bytes never fall in that class, so byte boundaries are character
boundaries.  Work is cut into blocks of about ``BLOCK`` bytes (never inside a
document), which bounds memory whatever the batch size.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = U(0x2545F4914F6CDD1D)
_BASE_INV = U(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + (BLOCK >> 1))
        for k, base in enumerate((_BASE, _BASE_INV)):
            row = np.full(size, base, U)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of a block of documents, in order."""

    data: np.ndarray  # bytes of the block
    start: np.ndarray  # byte offsets in data
    end: np.ndarray
    doc: np.ndarray  # row in the block
    first: np.ndarray  # first word of each row; one more entry than rows
    hash: np.ndarray  # 64-bit word hashes
    row0: int  # first row of the block in its batch
    rows: int


def blocks(column: pa.Array, fold: bool = False, block: int = BLOCK) -> Iterator[Words]:
    """Blocks of a string array; a null is a document without words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, off_buf, val_buf = column.buffers()
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(off_buf, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    vals = np.frombuffer(val_buf, np.uint8) if val_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + block, "right")) - 1)
        yield _block(vals[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row], row, fold)
        row = stop


def _block(data: np.ndarray, offs: np.ndarray, row0: int, fold: bool) -> Words:
    rows = len(offs) - 1
    size = len(data)
    if size == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z, np.zeros(rows + 1, np.int64), np.zeros(0, U), row0, rows)
    if fold:
        data = _FOLD[data]
    inside = ~_SPACE[data]
    edge = np.zeros(size + 1, bool)
    edge[offs] = True
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(rows), np.diff(first))
    up, down = _powers(size + 1)
    total = np.zeros(size + 1, U)
    np.cumsum(_BYTE[data] * up[:size], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix(h + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return Words(data, start, end, doc, first, h, row0, rows)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside one document, and their first words."""
    size = len(w.hash) - n + 1
    if size <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = w.hash[:size].copy()
    for k in range(1, n):
        g = g * U(0x9FB21C651E98DF25) + w.hash[k : size + k]
    at = np.flatnonzero(w.doc[:size] == w.doc[n - 1 :])
    return mix(g[at]), at


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges [start, end) one after the other, and their offsets."""
    size = end - start
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    kind = np.int32 if max(len(data), int(offs[-1])) < 1 << 31 else np.int64
    at = np.repeat((start - offs[:-1]).astype(kind), size)
    at += np.arange(offs[-1], dtype=kind)
    return data[at], offs


def binary_column(raw: np.ndarray, offs: np.ndarray, text: bool = False) -> pa.Array:
    """An Arrow binary (or string) column from bytes and offsets."""
    make = pa.StringArray if text else pa.BinaryArray
    if text:
        return make.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def tidy(run: Callable) -> Callable:
    """run, and when a task ends, memory that allocators keep goes back to the
    system: a Python worker outlives its tasks, and its executor's limit counts it."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task
