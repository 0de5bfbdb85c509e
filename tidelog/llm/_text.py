"""Columnar text work on Arrow batches: words as codes of a dictionary, without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once, whatever size the batches have.
CHUNK_BYTES = 2 << 20
#: The separators of ``[^\x20\x09-\x0D]+``.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def _trim() -> None:
    """Gives memory that is free again back to the system; the C library and Arrow keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text each, but of one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
            _trim()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and where each row starts in them, with the end of the last."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


#: Lower case for A to Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, at: np.ndarray, blanks: bytes | np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words stand: which bytes are inside one, starts, lengths, and the first word of each row (and the end)."""
    if isinstance(blanks, bytes):
        blank = np.zeros(256, bool)
        blank[list(blanks)] = True
    else:
        blank = blanks
    inside = ~blank[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = at[:-1][at[:-1] < len(data)]
    start[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    end[cut] = inside[cut]
    starts = np.flatnonzero(start)
    return inside, starts, np.flatnonzero(end) + 1 - starts, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes, eight at a time; words over 64 bytes through xxHash."""
    out = mix(lengths.astype(U64) + U64(0x9E3779B97F4A7C15))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), U64, padded, strides=(1,))
    for k in range(8):
        todo = slice(None) if k == 0 else np.flatnonzero((lengths > 8 * k) & (lengths <= 64))
        left = np.minimum(lengths[todo] - 8 * k, 8)
        if not len(left):
            break
        keep = U64(0xFFFFFFFFFFFFFFFF) >> ((8 - left).astype(U64) << U64(3))
        out[todo] = mix(out[todo] * U64(0x9E3779B97F4A7C15) ^ (eight.take(starts[todo] + 8 * k) & keep))
    for i in np.flatnonzero(lengths > 64).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


class Words:
    """The words of each row: ``codes`` into ``dictionary`` (bytes), ``n`` words a row, ``first`` the first of each row."""

    def __init__(self, column: pa.Array, lower: bool = False, blanks: bytes | np.ndarray = BLANKS):
        data, at = raw(column)
        if lower:
            data = LOWER[data]
        self.data, self.at = data, at
        self.inside, self.starts, lengths, self.first = spans(data, at, blanks)
        letters = data[self.inside]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        array = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        coded = array.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.letters = raw(coded.dictionary)
        self.n = np.diff(self.first)

    @cached_property
    def dictionary(self) -> list[bytes]:
        return pieces(*self.letters)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)


def pieces(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The values of a binary column; faster than its own conversion."""
    whole, ends = data.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row, where row i has the values from first[i] to first[i + 1]."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 for all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
