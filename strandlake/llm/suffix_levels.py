"""Exact substring de-duplication with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id. The strings of all
documents are dealt out by content: each string belongs to the k-gram inside it whose hash is smallest, so equal strings meet in one shard,
and neighbouring strings share one record (their union of bytes). In a shard the records come in the order of their doc_ids, in batches:

* the suffixes of a batch get a suffix array: positions, sorted by the first ``LENGTH`` bytes, which is as far as a match must reach;
* the array is merge-scanned against each existing level, and marks the suffixes that a level has;
* the new suffixes become a level, and levels of equal size merge, so there are logarithmically many.

``Family`` keeps the levels in shared storage: each ``add`` scans a new batch of documents against all that came before, whose ids count as
smaller. ``dedup`` answers one closed table; there a k-gram found in one document only can't match, so its records are not sent.

A k-gram in more than ``HOT`` documents is not dealt as one: its strings are dealt by their own 64-bit hash, of each of which a task sends the
smallest doc_id alone. So neither a passage in a third of all documents nor a line in many contexts meets in one task.

The marked intervals are dealt out by document into sorted, mapped files, and one last pass over the texts removes them, so that texts are never shuffled.

A null text is empty. A row with a null doc_id keeps all and is no source. Rows that repeat a doc_id are no sources for one another.
Ids that are not numbers are ordered as strings (as ranks, which are joined to the rows once). An empty table gives no row, and other columns are ignored.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from strandlake.llm.arrays import BLOBS, GATHERED, Gathered, blobs, by_shard, counted, dealt, hash_edges, heads, mapped, new_folder, planes, ranges, save, sliced
from strandlake.llm.text import Prefix, blocks, mix, powers, prefix_hash, span_hash
from strandlake.session import staged

LENGTH = 50
GRAM = 25
#: Records that a shard should have.
SHARD_RECORDS = 100_000
#: Documents beyond which a k-gram's strings are dealt one by one.
HOT = 2_000
#: Suffixes of a batch.
BATCH = 1 << 15
#: Distinct hot strings that a task gathers before it sends them on.
HOT_GATHERED = 1 << 20


def records(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """Runs of strings with one smallest k-gram: its hash, the first and last start (inclusive), and the prefix hashes of the block."""
    n = len(data)
    prefix = prefix_hash(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, prefix
    _, down = powers(n + 1)
    grams = mix((prefix.sums[GRAM:] - prefix.sums[:-GRAM]) * down[: n - GRAM + 1])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, LENGTH - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    inside = (np.cumsum(edge)[: len(place)] == 0)
    fresh, last = inside.copy(), inside.copy()
    fresh[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    last[:-1] &= ~inside[1:] | (place[1:] != place[:-1])
    first = np.flatnonzero(fresh)
    return grams[place[first]], first, np.flatnonzero(last), prefix


@dataclass(frozen=True)
class Grams:
    """Files of the sorted k-grams that own strings in several documents, and of those in very many."""

    folder: str
    shards: int
    sizes: np.ndarray
    records: int = 0

    def known(self, name: str, keys: np.ndarray) -> np.ndarray:
        """Which of the keys the files of ``name`` have."""
        order = np.argsort(keys, kind="stable")
        asked, out = keys[order], np.zeros(len(keys), bool)
        for k, a, b in ranges(asked, hash_edges(self.shards)):
            file = mapped(self.folder, f"{name}-{k}", int(self.sizes[k, ("grams", "hot").index(name)]))
            if len(file):
                at = np.minimum(np.searchsorted(file, asked[a:b]), len(file) - 1)
                out[order[a:b]] = file[at] == asked[a:b]
        return out


def repeated_grams(docs: DataFrame, folder: str, shards: int, most: int = HOT) -> Grams:
    edges = hash_edges(shards)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            for _, _, data, offsets in blocks(batch):
                grams, first, _, _ = records(data, offsets)
                if not len(grams):
                    continue
                order = np.argsort(grams, kind="stable")
                grams, owner = grams[order], np.searchsorted(offsets, first, side="right")[order]
                fresh = np.concatenate([[True], grams[1:] != grams[:-1]])
                other = fresh.copy()
                other[1:] |= owner[1:] != owner[:-1]
                head = np.flatnonzero(fresh)
                held.add(grams[head], np.add.reduceat(other.astype(np.uint64), head))
                if held.size > GATHERED:
                    yield blobs(list(sliced(*held.take(), edges)))
        if held.size:
            yield blobs(list(sliced(*held.take(), edges)))

    def finish(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, counts = counted(parts)
        save(folder, f"grams-{shard}", keys[counts > 1])
        save(folder, f"hot-{shard}", keys[counts > most])
        found = [shard, int((counts > 1).sum()), int((counts > most).sum()), int(counts[(counts > 1) & (counts <= most)].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()) for f in found], names=["shard", "n", "hot", "total"])

    rows = by_shard(docs.select("text").mapInArrow(apply, BLOBS), shards, finish, "shard long, n long, hot long, total long").collect()
    sizes = np.zeros((shards, 2), np.int64)
    for r in rows:
        sizes[r["shard"]] = r["n"], r["hot"]
    return Grams(folder, shards, sizes, sum(r["total"] for r in rows))


def row_keys(ids: np.ndarray, prefix: Prefix, offsets: np.ndarray) -> np.ndarray:
    """A key of each document from its id and its text."""
    return mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ span_hash(prefix, offsets[:-1], offsets[1:]))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, each in byte planes."""
    return zstandard.compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *map(planes, arrays)]), 1)


def stretch(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    """The arrays of a blob, and the bytes behind them."""
    raw = zstandard.decompress(blob, 1 << 31)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out, raw[at:]


SENT = "shard int, kind int, blob binary"
RECORD, INTERVAL, STRING = 0, 1, 2


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "kind", "blob"])


def _intervals(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, shards: int) -> list[tuple[int, int, bytes]]:
    """Blobs of intervals by the document's shard."""
    out, to = [], (keys % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((starts, keys, to))
    cuts = np.searchsorted(to[order], np.arange(shards + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if b > a:
            own = order[a:b]
            out.append((k, INTERVAL, squeeze(keys[own], starts[own], ends[own])))
    return out


class HotStrings:
    """The strings of hot k-grams that a task has met: of each hash the smallest document; the others' strings are settled at once."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, whole: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> None:
        self.parts.append((whole, doc, key, start))
        self.size += len(whole)

    def take(self, shards: int) -> list[tuple[int, int, bytes]]:
        """Blobs of strings by shard, and of the intervals that are settled."""
        held = [np.concatenate([p[k] for p in self.parts]) for k in range(4)]
        self.parts, self.size = [], 0
        (whole, doc, key, start), rows = least_of(*held, shards)
        to = (whole % np.uint64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for k, a, b in ranges(to[order], np.arange(shards)):
            own = order[a:b]
            rows.append((k, STRING, squeeze(whole[own], doc[own], key[own], start[own])))
        return rows


def least_of(whole: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, shards: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, bytes]]]:
    """The rows of each string's smallest document, and blobs of the other rows' intervals."""
    order = np.lexsort((start, key, doc, whole))
    whole, doc, key, start = whole[order], doc[order], key[order], start[order]
    head = heads(whole)
    stay = doc == np.repeat(doc[head], np.diff(np.append(head, len(whole))))
    gone = ~stay
    rows = _intervals(*merged(key[gone], start[gone], start[gone] + LENGTH), shards) if gone.any() else []
    return (whole[stay], doc[stay], key[stay], start[stay]), rows


def candidates(docs: DataFrame, grams: Grams | None, shards: int, gathered: int = HOT_GATHERED) -> DataFrame:
    """Records by shard, without those whose k-gram is known to be in one document; the strings of hot k-grams; and intervals that a task has settled by itself."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = HotStrings()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, offsets in blocks(batch):
                gram, first, last, prefix = records(data, offsets)
                if grams is not None:
                    own = grams.known("grams", gram)
                    gram, first, last = gram[own], first[own], last[own]
                if not len(gram):
                    continue
                owner = np.searchsorted(offsets, first, side="right") - 1
                doc, key = ids[row:end][owner], row_keys(ids[row:end], prefix, offsets)[owner]
                rows = []
                if grams is not None and (hot := grams.known("hot", gram)).any():
                    n = last[hot] - first[hot] + 1
                    at = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    strings.add(span_hash(prefix, at, at + LENGTH), np.repeat(doc[hot], n), np.repeat(key[hot], n), at - np.repeat(offsets[owner[hot]], n))
                    if strings.size > gathered:
                        rows += strings.take(shards)
                    gram, first, last, owner, doc, key = (x[~hot] for x in (gram, first, last, owner, doc, key))
                stop = last + LENGTH
                # of equal records in a block, those of a larger doc_id go at once
                whole = span_hash(prefix, first, stop)
                order = np.lexsort((doc, whole))
                head = heads(whole[order])
                least = np.empty(len(doc), np.int64)
                least[order] = np.repeat(doc[order][head], np.diff(np.append(head, len(order))))
                start = first - offsets[owner]
                size = stop - first
                gone = doc > least
                rows += _intervals(key[gone], start[gone], (start + size)[gone], shards)
                gram, doc, key, start, size, first = (x[~gone] for x in (gram, doc, key, start, size, first))
                to = (gram >> np.uint64(8)) % np.uint64(shards)
                order = np.argsort(to, kind="stable")
                for k, a, b in ranges(to[order], np.arange(shards, dtype=np.uint64)):
                    mine = order[a:b]
                    text = b"".join(data[s:e].tobytes() for s, e in zip(first[mine].tolist(), (first + size)[mine].tolist(), strict=True))
                    raw = len(mine).to_bytes(8, "little") + b"".join(map(planes, (doc[mine], key[mine], start[mine], size[mine].astype(np.int32)))) + text
                    rows.append((k, RECORD, zstandard.compress(raw, 1)))
                yield _sent(rows)
        if strings.size:
            yield _sent(strings.take(shards))

    return docs.select("doc_id", "text").mapInArrow(apply, SENT)


@dataclass
class Levels:
    """Suffix arrays of geometric sizes over one text: positions in it, in the order of the suffixes' first ``LENGTH`` bytes."""

    text: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    levels: dict[int, np.ndarray] = field(default_factory=dict)

    def has(self, ordered: np.ndarray) -> np.ndarray:
        """Which of the sorted distinct suffixes a level has (the merge scan: both sides are in order)."""
        out = np.zeros(len(ordered), bool)
        for level in self.levels.values():
            own = suffixes(self.text, level)
            at = np.minimum(np.searchsorted(own, ordered), len(own) - 1)
            out |= own[at] == ordered
        return out

    def add(self, positions: np.ndarray) -> None:
        """A new level of positions that are sorted by their suffixes."""
        if not len(positions):
            return
        rank = (len(positions) // BATCH).bit_length()
        while rank in self.levels:
            both = np.concatenate([self.levels.pop(rank), positions])
            # a stable sort of two sorted runs is a merge
            positions = both[np.argsort(suffixes(self.text, both), kind="stable")]
            rank = max(rank + 1, (len(positions) // BATCH).bit_length())
        self.levels[rank] = positions


def suffixes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first bytes of the suffixes at ``starts``."""
    return np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts].view(f"S{LENGTH}").ravel() if len(starts) else np.zeros(0, f"S{LENGTH}")


def matched(doc: np.ndarray, first: np.ndarray, size: np.ndarray, levels: Levels) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For records of the levels' text in the order of their documents: record, first and last matching string, in batches."""
    strings = size - LENGTH + 1
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, np.int64)
    upto = np.concatenate([[0], np.cumsum(strings)])
    at = 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(upto[edges], upto[edges[at]] + BATCH, side="right")) - 1)
        own = np.arange(edges[at], edges[end])
        n = strings[own]
        record = np.repeat(own, n)
        within = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
        place = first[record] + within
        batch = suffixes(levels.text, place)
        order = np.argsort(batch, kind="stable")
        ordered = batch[order]
        head = heads(ordered)
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(ordered))))
        old = levels.has(ordered[head])
        levels.add(place[order][head][~old])
        hit = np.zeros(len(batch), bool)
        hit[order] = old[run] | (doc[record[order]] > doc[record[order]][head][run])
        starts, ends = hit.copy(), hit.copy()
        joined = (record[1:] == record[:-1]) & hit[1:] & hit[:-1]
        starts[1:] &= ~joined
        ends[:-1] &= ~joined
        a, b = np.flatnonzero(starts), np.flatnonzero(ends)
        yield record[a], within[a], within[b]
        at = end


def settle(parts: list[bytes], shards: int, levels: Levels) -> list[tuple[int, int, bytes]]:
    """The intervals of one shard's records; the levels take in their text."""
    held = [stretch(b, "<i8", "<u8", "<i8", "<i4") for b in parts]
    doc, key, start, size = (np.concatenate([h[0][k] for h in held]) for k in range(4))
    text = np.frombuffer(b"".join(h[1] for h in held), np.uint8)
    size = size.astype(np.int64)
    first = np.cumsum(size) - size
    # equal records are settled once, for the smallest doc_id
    whole = span_hash(prefix_hash(text), first, first + size)
    order = np.lexsort((doc, whole))
    head = np.zeros(len(order), bool)
    head[heads(whole[order])] = True
    group = np.empty(len(doc), np.int64)
    group[order] = np.cumsum(head) - 1
    leader = order[head]
    gone = doc > doc[leader][group]
    out = [(key[gone], start[gone], (start + size)[gone])]
    rank = np.argsort(doc[leader], kind="stable")
    ordered = leader[rank]
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    rest = np.flatnonzero(~gone)
    rest = rest[np.argsort(place[group[rest]], kind="stable")]
    lead = place[group[rest]]
    base = len(levels.text)
    levels.text = np.concatenate([levels.text, text])
    for record, a, b in matched(doc[ordered], base + first[ordered], size[ordered], levels):
        low, high = np.searchsorted(lead, record), np.searchsorted(lead, record, side="right")
        n = high - low
        mine = rest[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        out.append((key[mine], start[mine] + np.repeat(a, n), start[mine] + np.repeat(b, n) + LENGTH))
    return _intervals(*(np.concatenate([o[k] for o in out]) for k in range(3)), shards)


def settled(sent: DataFrame, shards: int, family: Family | None = None) -> DataFrame:
    """Blobs of all intervals by the document's shard."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        strings: dict[int, list[bytes]] = {}
        for batch in batches:
            passed = []
            for shard, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == INTERVAL:
                    passed.append((shard, kind, blob))
                else:
                    (held if kind == RECORD else strings).setdefault(shard, []).append(blob)
            if passed:
                yield _sent(passed)
        while strings:
            parts = [stretch(b, "<u8", "<i8", "<u8", "<i8")[0] for b in strings.popitem()[1]]
            rows = least_of(*(np.concatenate([p[k] for p in parts]) for k in range(4)), shards)[1]
            if rows:
                yield _sent(rows)
        while held:
            shard, parts = held.popitem()
            levels = family.load(shard) if family else Levels()
            rows = settle(parts, shards, levels)
            if family:
                rows.append((-1, shard, family.store(shard, levels)))
            if rows:
                yield _sent(rows)

    return dealt(sent, shards).mapInArrow(apply, SENT)


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted intervals, those of a document that touch being one."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    fresh = np.zeros(len(key), np.int64)
    fresh[heads(key)] = 1
    base = np.cumsum(fresh) << 40  # keeps documents apart
    far = np.maximum.accumulate(end + base)
    new = np.ones(len(key), bool)
    new[1:] = (start + base)[1:] > far[:-1]
    head = np.flatnonzero(new)
    return key[head], start[head], np.maximum.reduceat(end, head) if len(head) else end


def write_intervals(sent: DataFrame, folder: str, shards: int) -> np.ndarray:
    """Files of document keys and their intervals, sorted; returns their lengths."""

    def finish(shard: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        held = [stretch(b, "<u8", "<i8", "<i8")[0] for b in parts]
        key, start, end = merged(*(np.concatenate([h[k] for h in held]) for k in range(3)))
        save(folder, f"keys-{shard}", key)
        save(folder, f"spans-{shard}", np.column_stack([start, end]))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(key)], pa.int64())], names=["shard", "n"])

    sizes = np.zeros(shards, np.int64)
    for r in by_shard(sent.filter("shard >= 0").select("shard", "blob"), shards, finish, "shard int, n long").collect():
        sizes[r["shard"]] = r["n"]
    return sizes


@dataclass
class Family:
    """The levels of all shards in shared storage; each ``add`` scans a batch of documents against them and takes it in.

    Every state is written under its own version, and replaces the one before when the whole batch is done. So a lost executor or a
    batch that failed leaves the family as it was.
    """

    spark: SparkSession
    shards: int
    folder: str
    state: dict[int, dict[str, int]] = field(default_factory=dict)
    version: int = 0

    @classmethod
    def new(cls, spark: SparkSession, shards: int) -> Family:
        return cls(spark, shards, new_folder(spark, "family"))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"spark": None}

    def load(self, shard: int) -> Levels:
        sizes = dict(self.state.get(shard, {}))
        if not sizes:
            return Levels()
        stem = f"{sizes.pop('version')}-{shard}"
        return Levels(np.array(mapped(self.folder, f"text-{stem}", sizes.pop("text"))), {int(rank): np.array(mapped(self.folder, f"level-{rank}-{stem}", n)) for rank, n in sizes.items()})

    def store(self, shard: int, levels: Levels) -> bytes:
        """Writes a shard's next state; returns its array lengths."""
        stem = f"{self.version + 1}-{shard}"
        save(self.folder, f"text-{stem}", levels.text)
        for rank, positions in levels.levels.items():
            save(self.folder, f"level-{rank}-{stem}", positions)
        return repr({"version": self.version + 1, "text": len(levels.text)} | {str(rank): len(p) for rank, p in levels.levels.items()}).encode()

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """The answers of ``dedup`` for a batch whose ids count as larger than all before."""
        docs, sources = _sources(docs)
        sent = staged(settled(candidates(sources, None, self.shards), self.shards, self), "family")
        state = {r["kind"]: ast.literal_eval(r["blob"].decode()) for r in sent.filter("shard = -1").collect()}  # array lengths of each shard
        folder = new_folder(self.spark, "intervals")
        sizes = write_intervals(sent, folder, self.shards)
        self.state, self.version = self.state | state, self.version + 1
        return _kept(docs, folder, sizes, with_text)


def removed(folder: str, sizes: np.ndarray, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each byte of a block goes."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    to = (keys % np.uint64(len(sizes))).astype(np.int64)
    for k in np.unique(to).tolist():
        own = np.flatnonzero(to == k)
        file = mapped(folder, f"keys-{k}", int(sizes[k]))
        if not len(file):
            continue
        low, high = np.searchsorted(file, keys[own]), np.searchsorted(file, keys[own], side="right")
        n = high - low
        rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        spans, base = mapped(folder, f"spans-{k}", len(file))[rows], np.repeat(offsets[:-1][own], n)
        np.add.at(edge, spans[:, 0] + base, 1)
        np.add.at(edge, spans[:, 1] + base, -1)
    return np.cumsum(edge)[:-1] > 0


def _sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their ids as ``key`` (long), and the rows that can be sources. Ids that are no integers become their ranks."""
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("key"), "text")
    else:
        ranked = staged(ranks(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "doc_id"), "ranks")
        rows = docs.select("doc_id", "text").join(ranked.withColumnRenamed("doc_id", "ranked"), F.col("doc_id") == F.col("ranked"), "left").select("doc_id", F.col("rank").alias("key"), "text")
    return rows, rows.filter("key IS NOT NULL").select(F.col("key").alias("doc_id"), "text")


def ranks(ids: DataFrame, column: str) -> DataFrame:
    """Distinct values with their ``rank`` in order: ranges, whose sizes (one number each) give every range its offset."""
    part = ids.repartitionByRange(column).withColumn("part", F.spark_partition_id())
    part = staged(part.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(column))), "ranked")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    return part.join(F.broadcast(sizes), "part").select(column, (F.col("before") + F.col("within")).alias("rank"))


def dedup(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes) for every document."""
    spark = docs.sparkSession
    folder = new_folder(spark, "substrings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs, sources = _sources(docs)
    grams = repeated_grams(sources, folder, parts, hot)
    shards = max(parts, grams.records // SHARD_RECORDS + 1)
    return _kept(docs, folder, write_intervals(settled(candidates(sources, grams, shards), shards), folder, shards), with_text)


def _kept(docs: DataFrame, folder: str, sizes: np.ndarray, with_text: bool) -> DataFrame:
    """The answers for rows (doc_id, key, text) whose intervals are written."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column("key").is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column("key"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, offsets in blocks(batch):
                gone = removed(folder, sizes, row_keys(ids[row:end], prefix_hash(data), offsets), offsets)
                for k in np.flatnonzero(null[row:end]).tolist():
                    gone[offsets[k] : offsets[k + 1]] = False
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                heads = offsets[:-1][offsets[:-1] < len(gone)]
                first[heads] = gone[heads]
                lost, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, first))
                kept = [data[a:b][~gone[a:b]].tobytes() if n else data[a:b].tobytes() for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lost.tolist(), strict=True)]
                out = [batch.column("doc_id").slice(row, end - row), pa.array(np.diff(offsets)), pa.array(lost), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.binary())] if with_text else out, names=[*names, "kept"] if with_text else names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return docs.mapInArrow(apply, schema)
