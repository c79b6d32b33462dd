"""Arrow batches in pieces of bounded bytes, so that a worker's memory does not depend on Spark's batch size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows are handled in pieces of about so many bytes; a longer row is a piece of its own.
PIECE_BYTES = 4 << 20


def row_bytes(column: pa.Array) -> np.ndarray:
    """About how many bytes each row of a column holds; a null string or list holds none."""
    t = column.type
    if not len(column):
        return np.zeros(0, np.int64)
    if pa.types.is_binary(t) or pa.types.is_string(t) or pa.types.is_large_binary(t) or pa.types.is_large_string(t):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        before = np.concatenate([[0], np.cumsum(row_bytes(column.values))])
        return np.diff(before[column.offsets.to_numpy()])
    if pa.types.is_struct(t):
        return sum((row_bytes(column.field(i)) for i in range(t.num_fields)), np.zeros(len(column), np.int64))
    return np.full(len(column), 8)


def pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES, raw: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``size`` bytes; column ``raw`` tells how many bytes a row will grow to."""
    held = sum((row_bytes(x) for x in batch.columns), np.zeros(batch.num_rows, np.int64))
    if raw is not None:
        # damaged lengths may be anything
        grown = pc.fill_null(batch.column(batch.schema.get_field_index(raw)).cast(pa.int64()), 0)
        held += np.clip(grown.to_numpy(zero_copy_only=False), 0, size)
    at = np.concatenate([[0], np.cumsum(held)])
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def release() -> None:
    """Gives freed memory back to the system, so that a worker keeps no more than it uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library frees by itself
        return


def by_pieces(code: Callable[[pa.RecordBatch], pa.RecordBatch], raw: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``code`` on one piece after the other. What a piece needs is freed before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, raw=raw):
                yield code(piece)
                release()

    return run
