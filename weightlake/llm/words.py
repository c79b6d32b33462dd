"""Words of Arrow text columns, as flat arrays.

A word is a maximal run of bytes other than space and \\x09-\\x0D. All
functions take whole columns; no text is cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Texts are handled in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and where each row starts (one more entry than rows). Null is empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system, so that a worker keeps no more than it uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library frees by itself
        return


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text, so that memory does not depend on Spark's batch size."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            release()
            first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes unchanged."""
    return np.frombuffer(data.tobytes().lower(), dtype=np.uint8)


@dataclass
class Words:
    """Words of all rows end to end: word i is ``values[i]``; row d has the words ``rows[d]:rows[d + 1]``."""

    values: pa.Array
    rows: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word, and the distinct words by code."""
        found = self.values.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def find_words(col: pa.Array, lower: bool = False, breaks: Callable[[np.ndarray], np.ndarray] | None = None) -> Words:
    """The words of a column; ``breaks`` may tell more places, as a mask over the bytes, where a word starts."""
    data, at = text_bytes(col)
    n = len(data)
    if lower and n:
        data = lower_ascii(data)
    space = _SPACE[data]
    solid = ~space
    begins, ends = solid.copy(), solid.copy()
    if n:
        edge = space.copy()
        if breaks is not None:
            edge[:-1] |= breaks(data)[1:]
        begins[1:] &= edge[:-1]
        heads = at[:-1][at[:-1] < n]
        begins[heads] = solid[heads]
        edge[:-1] |= begins[1:]
        edge[:-1] |= space[1:]
        ends[:-1] &= edge[:-1]
        tails = at[1:][at[1:] > 0] - 1
        ends[tails] = solid[tails]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) - starts + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    return Words(values, np.searchsorted(starts, at), starts, lengths)


def hash_values(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each value."""
    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(x, seed) for x in values.to_pylist()), dtype=np.uint64, count=len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(codes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of each ``width`` consecutive values, over row ends too; len(codes) - width + 1 of them.

    Built by doubling, so the cost grows with log(width).
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * seed & 0xFFFFFFFFFFFFFFFF)
    have: np.ndarray | None = None
    have_width, block, block_width = 0, codes.astype(np.uint64), 1
    rest = width
    while rest:
        if rest & 1:
            if have is None:
                have, have_width = block, block_width
            else:
                m = len(codes) - have_width - block_width + 1
                have = mix(have[:m] * factor + block[have_width : have_width + m])
                have_width += block_width
        rest >>= 1
        if rest:
            m = len(codes) - 2 * block_width + 1
            block = mix(block[:m] * factor + block[block_width : block_width + m])
            block_width *= 2
    return have[:n]


def whole_windows(rows: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """True for each window start whose ``width`` words are all of one row."""
    n = n_words - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    good = np.ones(n_words, bool)
    for back in range(1, width):
        ends = rows[1:] - back
        good[ends[(ends >= 0) & (ends >= rows[:-1])]] = False
    return good[:n]


def row_of(rows: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values; log(width) passes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: n], out[width - have : width - have + n])
    return out[:n]
