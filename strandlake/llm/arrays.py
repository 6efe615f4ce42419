"""Sorted arrays in the shared folder: partial counts packed into blobs, brought together by shard, and stored as files that workers map.

Every array is written under a name of its own first, so a second attempt of a task does no harm. A reader states how long an
array must be, so a file that is missing or short on some node is an error and never an empty answer. Where the shared folder is
mounted (a ``file:`` path) files are memory-mapped; in an object store or HDFS a worker reads the arrays that it asks for and keeps a few.
"""

from __future__ import annotations

import json
import mmap
import os
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import scratch_path

#: Distinct keys that a task gathers before it sends them on.
GATHERED = 4_000_000
BLOBS = "shard int, blob binary"


def planes(array: np.ndarray) -> bytes:
    """The bytes of an array, place by place."""
    return np.ascontiguousarray(np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T).tobytes()


def pack(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 64-bit keys, their counts and further numbers as a small blob: byte planes of the keys' differences, compressed."""
    parts = [np.diff(keys, prepend=np.uint64(0)).astype("<u8"), counts.astype("<u8"), *(m.astype("<u8") for m in more)]
    return len(keys).to_bytes(8, "little") + zstandard.compress(b"".join(map(planes, parts)), 1)


def unpack(blob: bytes, arrays: int = 2) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.decompress(blob[8:], n * 8 * arrays), np.uint8).reshape(arrays, 8, n)
    keys, *others = (np.ascontiguousarray(p.T).view("<u8").ravel().astype(np.uint64) for p in raw)
    return (np.cumsum(keys, dtype=np.uint64), *others)


def heads(*keys: np.ndarray) -> np.ndarray:
    """The first place of each run of equal rows."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(keys) > 1 else keys[0][1:] != keys[0][:-1]
    return np.flatnonzero(new)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
        first = heads(keys)
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = heads(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.uint64)


class Gathered:
    """Keys with counts that a task holds, compacted whenever they are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.uint64)
        self.parts, self.size = [], 0
        return summed(keys, counts)


def ranges(keys: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shard, first and end place of sorted keys, for each range of ``edges`` (lower ends) that has keys."""
    cuts = np.append(np.searchsorted(keys, edges), len(keys)).tolist()
    cuts[0] = 0
    return ((k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a)


def sliced(keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A packed blob for each range of ``edges`` that has keys."""
    return ((shard, pack(keys[a:b], counts[a:b])) for shard, a, b in ranges(keys, edges))


def blobs(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], names=["shard", "blob"])


_slots: dict[int, str] = {}


def dealt(frame: DataFrame, n: int, column: str = "shard") -> DataFrame:
    """Repartitions rows so that each of the shards 0 to n-1 has a task of its own.

    Shard numbers themselves would be hashed, and several meet in one task. So each is dealt by a number that Spark's hash takes to its place,
    found among the first few multiples of n.
    """
    spark = frame.sparkSession
    if n not in _slots:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("place")
        found = {r["place"]: r["id"] for r in spark.range(0, 24 * n).groupBy(place).agg(F.min("id").alias("id")).collect()}
        _slots[n] = json.dumps([found.get(k, k) for k in range(n)])
    slot = F.get(F.from_json(F.lit(_slots[n]), "array<int>"), F.col(column))
    return frame.withColumn("strandlake_slot", slot).repartition(n, "strandlake_slot").drop("strandlake_slot")


def by_shard(frame: DataFrame, n: int, finish: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the blobs of a shard together; ``finish(shard, blobs)`` gives the rows of a result."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(shard, []).append(blob)
        while held:
            yield from finish(*held.popitem())

    return dealt(frame, n).mapInArrow(apply, schema)


def counted(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of packed keys and counts."""
    own = Gathered()
    while parts:
        own.add(*unpack(parts.pop()))
        if own.size > 4 * GATHERED:  # what has been summed does not count again
            own.parts, own.size = [own.take()], 0
    return own.take()


def hash_edges(shards: int) -> np.ndarray:
    """Lower ends of equal ranges of 64-bit hashes."""
    return (np.arange(shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder for arrays: a plain path where the shared folder is mounted, else its address."""
    path = scratch_path(spark, label)
    plain = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in plain:
        return plain
    os.makedirs(plain, exist_ok=True)
    return plain


def save(folder: str, name: str, array: np.ndarray) -> None:
    path = f"{folder}/{name}.npy"
    own = f"{path}.{uuid.uuid4().hex}"
    if "://" not in folder:
        with open(own, "wb") as f:
            np.save(f, array)
        os.replace(own, path)
        return
    store, at = pyarrow.fs.FileSystem.from_uri(own)
    with store.open_output_stream(at) as f:
        np.save(f, array)
    store.move(at, at.removesuffix(own[len(path) :]))


#: Files that a worker keeps mapped: those of some five billion keys. A process may have 65,530 maps by Linux's default.
MAPPED_FILES = 32_768


@lru_cache(maxsize=MAPPED_FILES)
def _opened(folder: str, name: str) -> np.ndarray:
    # a plain array and no np.memmap, which costs microseconds at each step; a map without an open file, of which a process may have few
    with open(f"{folder}/{name}.npy", "rb") as f:
        np.lib.format.read_magic(f)
        shape, fortran, kind = np.lib.format.read_array_header_1_0(f)
        held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
        return np.frombuffer(held, kind, int(np.prod(shape)), f.tell()).reshape(shape, order="F" if fortran else "C")


#: Bytes of arrays that a worker keeps of a store that is not mounted.
KEPT_BYTES = 256 << 20
_kept: dict[tuple[str, str], np.ndarray] = {}


def _fetched(folder: str, name: str) -> np.ndarray:
    """An array of a store that is not mounted; those asked for last are kept, up to ``KEPT_BYTES`` besides this one."""
    found = _kept.pop((folder, name), None)
    if found is None:
        store, at = pyarrow.fs.FileSystem.from_uri(f"{folder}/{name}.npy")
        with store.open_input_stream(at) as f:
            found = np.load(pa.BufferReader(f.read()))
        while _kept and sum(a.nbytes for a in _kept.values()) + found.nbytes > KEPT_BYTES:
            del _kept[next(iter(_kept))]
    _kept[folder, name] = found
    return found


def mapped(folder: str, name: str, size: int) -> np.ndarray:
    """The array of that name, which has ``size`` rows; a missing or different one is an error. Of no rows none was written."""
    if not size:
        return np.zeros(0, np.uint64)
    found = _fetched(folder, name) if "://" in folder else _opened(folder, name)
    if len(found) != size:
        raise RuntimeError(f"{folder}/{name} has {len(found)} rows in place of {size}")
    return found
