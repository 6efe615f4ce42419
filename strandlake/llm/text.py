"""Byte-level text kernels shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a kernel handles at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words split at blanks: all but 0x20 and 0x09-0x0D.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of alphanumeric words: digits, a-z and all of UTF-8's bytes beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about ``most`` bytes: first row, end row, their bytes and offsets."""
    data, at = utf8(batch.column(column))
    n, row = len(at) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches; at its end the worker, which waits for other tasks, gives the memory that it no longer uses back."""
    try:
        yield from rows
    finally:
        _trim()


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``mask`` that do not cross a row: starts, ends, and the first run of each row (n+1)."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    tail = offsets[1:][offsets[1:] > 0] - 1
    last[tail] = mask[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64."""
    if len(_cache.get("up", ())) < n:
        n = -(-n >> 20) << 20  # in steps of 2**20, as they stay in memory
        _cache["up"], _cache["down"] = _powers(_ODD, n), _powers(_INVERSE, n)
    return _cache["up"], _cache["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, in place on a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Bytes of a span beyond which its hash is XXH64: sums modulo 2**64 are alike for some periodic spans of 1,024 bytes and more.
SHORT = 64


@dataclass(frozen=True)
class Prefix:
    """A block's bytes with the n+1 prefix sums of a polynomial hash modulo 2**64."""

    data: np.ndarray
    sums: np.ndarray


def prefix_hash(data: np.ndarray) -> Prefix:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return Prefix(data, out)


def span_hash(prefix: Prefix, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes get equal hashes wherever they stand. Spans of more than ``SHORT`` bytes are hashed one by one."""
    sums, size = prefix.sums, ends - starts
    _, down = powers(len(sums))
    h = mix((sums[ends] - sums[starts]) * down[starts] ^ (size.astype(np.uint64) << np.uint64(56)))
    if len(long := np.flatnonzero(size > SHORT)):
        view = memoryview(np.ascontiguousarray(prefix.data))
        h[long] = [xxhash.xxh64_intdigest(view[a:b], 42) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h
