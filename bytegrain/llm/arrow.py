"""Helpers of the Arrow functions: byte-bounded slices and packed integer columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20  # text that a Python list of words is made of at a time


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most `limit` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def pack(*arrays: Sequence[int] | np.ndarray, blob: bytes = b"") -> bytes:
    """Arrays of unsigned 32-bit integers, by byte planes, and a blob, compressed."""
    parts = [np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()]
    for values in arrays:
        planes = np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4)
        parts.append(planes.T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, blob]))


def unpack(packed: bytes) -> tuple[list[np.ndarray], bytes]:
    """What `pack` was given."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    at, arrays = 4 * (count + 1), []
    for size in np.frombuffer(raw, "<u4", count, 4).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view("<u4"))
        at += 4 * size
    return arrays, raw[at:]


def ddl(df: DataFrame, name: str) -> str:
    """The type of a column, for a schema string."""
    return df.schema[name].dataType.simpleString()


def release() -> None:
    """Give back memory that is no longer used; a worker outlives the task that took it."""
    gc.collect()
    trim()


def trim() -> None:
    """As `release`, without a search for cycles, which takes as long as a small task."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim is not None:
        malloc_trim(0)


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches; its worker gives memory back when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    return run
