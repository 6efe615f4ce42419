"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: each of its rows covers a block of documents of about two megabytes and stores
every token's postings (sorted term hashes, list offsets, and token positions, blocks' documents being set apart by gaps).
It is written to the shared folder. A query part takes the benchmark's windows; in every block it drops windows with
an absent term, starts from the postings of each window's rarest term, and intersects them with the offset-adjusted
lists of the other terms from rare to common. Terms are 64-bit hashes of whole words.

The benchmark is sent to the workers in parts of about ``PART_BYTES`` of text, as many as its checked size asks for, one after the other:
the driver holds the windows of one part (some 14 bytes for each byte of its text), and what each part hits is written before the next one comes.
The parts' hits meet in a group for each document that was hit.

Null texts have no words. Items without words have no window. An item with a null id marks words, but is not
listed. Repeated rows are answered one by one, null doc_ids are kept, an empty table gives no row, and an empty benchmark
hits nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.text import LOWER, WORD, blocks, prefix_hash, released, runs, span_hash
from strandlake.session import staged, temporary

WIDTH = 10
#: Bytes of benchmark text whose windows are broadcast together.
PART_BYTES = 4 << 20
#: Bytes of text in a row of the index; a worker needs some sixty times that.
INDEX_BYTES = 2 << 20
#: Candidate places that are intersected at once.
PLACES = 1 << 21
BROADCAST_BYTES = 64 << 20
INDEX = "block long, ids array<{id}>, counts binary, terms binary, offsets binary, positions binary"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a block of texts, and the first word of each text (n+1)."""
    low = LOWER[data]
    starts, ends, first = runs(WORD[low], offsets)
    return span_hash(prefix_hash(low), starts, ends), first


def build_index(docs: DataFrame) -> DataFrame:
    """Rows of the index, one for each block of documents."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, end, data, offsets in blocks(batch, most=INDEX_BYTES):
                words, first = word_hashes(data, offsets)
                counts = np.diff(first)
                position = np.arange(len(words)) + np.repeat(np.arange(len(counts)) * WIDTH, counts)
                order = np.argsort(words, kind="stable")
                words = words[order]
                heads = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
                blobs = [counts.astype("<i4"), words[heads], np.append(heads, len(words)).astype("<i4"), position[order].astype("<i4")]
                ids = batch.column(0).slice(row, end - row)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["block", "ids", "counts", "terms", "offsets", "positions"])
                block += 1

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda batches: released(apply(batches)), INDEX.format(id=rows.schema["doc_id"].dataType.simpleString()))


@dataclass
class Windows:
    """The distinct windows of a part of the benchmark: their words (padded), lengths, and the items that have them."""

    words: np.ndarray
    length: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], width: int = WIDTH) -> Windows:
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], names=["text"])
        rows, lengths, owners = [np.zeros((0, width), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, _, data, offsets in blocks(batch):
            words, first = word_hashes(data, offsets)
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                n = min(width, b - a)
                if n:
                    found = np.zeros((b - a - n + 1, width), np.uint64)
                    found[:, :n] = np.lib.stride_tricks.sliding_window_view(words[a:b], n)
                    rows.append(found)
                    lengths.append(np.full(len(found), n))
                    owners.append(np.full(len(found), row + k))
        table = np.column_stack([np.concatenate(lengths).astype(np.uint64), np.concatenate(rows)])
        distinct, which = np.unique(table, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([which.reshape(-1), np.concatenate(owners)]), axis=0) if len(table) else np.zeros((0, 2), np.int64)
        return cls(distinct[:, 1:], distinct[:, 0].astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1], [n for n, _ in items])


class Block:
    """One row of the index, opened for queries."""

    def __init__(self, counts: bytes, terms: bytes, offsets: bytes, positions: bytes):
        self.counts, self.terms, self.offsets = np.frombuffer(counts, "<i4").astype(np.int64), np.frombuffer(terms, np.uint64), np.frombuffer(offsets, "<i4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<i4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts + WIDTH)])
        self.postings: np.ndarray | None = None

    def _find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return at, (self.terms[at] == words if len(self.terms) else np.zeros(words.shape, bool))

    def _listed(self) -> np.ndarray:
        """Term and position of every posting as one sorted number."""
        if self.postings is None:
            self.postings = (np.repeat(np.arange(len(self.terms)), np.diff(self.offsets)) << 32) | self.positions
        return self.postings

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Each place of each window: the window's number and its first position."""
        width = windows.words.shape[1]
        inside = np.arange(width)[None, :] < windows.length[:, None]
        terms, known = self._find(windows.words)
        alive = np.flatnonzero((known | ~inside).all(axis=1)) if len(self.terms) else np.zeros(0, np.int64)
        terms, inside = terms[alive], inside[alive]
        found = np.where(inside, self.offsets[terms + 1] - self.offsets[terms], np.iinfo(np.int64).max) if len(alive) else terms
        by_rarity = np.argsort(found, axis=1, kind="stable") if len(alive) else terms
        seeds = np.take_along_axis(found, by_rarity[:, :1], axis=1)[:, 0] if len(alive) else np.zeros(0, np.int64)
        out_w, out_p, at = [], [], 0
        until = np.cumsum(seeds)
        while at < len(alive):
            end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PLACES, side="right")))
            own = np.arange(at, end)
            n = seeds[at:end]
            w = np.repeat(own, n)
            within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            slot = by_rarity[w, 0]
            place = self.positions[self.offsets[terms[w, slot]] + within] - slot
            for k in range(1, width):
                slot = by_rarity[w, k]
                asked = inside[w, slot]
                want = (terms[w, slot] << 32) | (place + slot)
                listed = self._listed()
                hit = np.minimum(np.searchsorted(listed, want), len(listed) - 1)
                keep = ~asked | ((place >= 0) & (listed[hit] == want))
                w, place = w[keep], place[keep]
                if not len(w):
                    break
            out_w.append(alive[w])
            out_p.append(place)
            at = end
        return (np.concatenate(out_w), np.concatenate(out_p)) if out_w else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def near(self, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose words lie within their length and ``slop`` of a place of their rarest word, and that place."""
        out: list[tuple[int, np.ndarray]] = []
        for w in range(len(windows.length)):
            n = int(windows.length[w])
            terms, known = self._find(windows.words[w, :n])
            if not known.all():
                continue
            order = np.argsort(self.offsets[terms + 1] - self.offsets[terms], kind="stable")
            seed = terms[order[0]]
            place, reach = self.positions[self.offsets[seed] : self.offsets[seed + 1]], n - 1 + slop
            for t in terms[order[1:]]:
                low = np.maximum(place - reach, self.starts[np.searchsorted(self.starts, place, side="right") - 1])
                own = self.positions[self.offsets[t] : self.offsets[t + 1]]
                at = np.searchsorted(own, low)
                row = np.searchsorted(self.starts, place, side="right") - 1
                place = place[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= np.minimum(place + reach, self.starts[row] + self.counts[row] - 1))]
            if len(place):
                out.append((w, place))
        return np.repeat([w for w, _ in out], [len(p) for _, p in out]).astype(np.int64), np.concatenate([p for _, p in out]) if out else np.zeros(0, np.int64)

    def covered(self, windows: Windows, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each position is inside a hit, and the distinct (document, item) pairs."""
        edge = np.zeros(int(self.starts[-1]) + WIDTH + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + windows.length[w], -1)
        n = windows.first[w + 1] - windows.first[w]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        items = windows.items[np.repeat(windows.first[w], n) + within]
        docs = np.repeat(np.searchsorted(self.starts, place, side="right") - 1, n)
        return np.cumsum(edge)[: int(self.starts[-1])] > 0, np.unique(np.column_stack([docs, items]), axis=0)


def _summary(hit: int, items: set[str]) -> tuple[int, int, str]:
    return hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _names() -> list[str]:
    return ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _parts(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """The number of the benchmark's parts of bounded size, and the parts one by one."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // PART_BYTES) + 1
    part = lambda k: rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return n, ([(r["item"], r["text"]) for r in part(k).collect()] for k in range(n))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    spark = docs.sparkSession
    index = staged(build_index(docs), "index")
    n_parts, parts = _parts(benchmark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if n_parts == 1:
        return _answers(index, spark.sparkContext.broadcast(Windows.of(next(parts))), schema)
    every = None
    for items in parts:
        shared = spark.sparkContext.broadcast(Windows.of(items))
        one = staged(_hits(index, shared), "hits")
        shared.destroy()
        every = one if every is None else every.union(one)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bits, items = np.zeros(max(len(r["hits"]) for r in rows), np.uint8), set()
        for r in rows:
            items.update(r["items"])
            bits |= np.frombuffer(r["hits"], np.uint8)
        hit, n, digest = _summary(int(np.bitwise_count(bits).sum()), items)
        return pa.table([table.column("block").slice(0, 1), table.column("row").slice(0, 1), pa.array([hit], pa.int64()), pa.array([n], pa.int64()), pa.array([digest])], names=["block", "row", "n_hit", "n_items", "items_sha256"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, n = batch.column(1)[k].values, np.frombuffer(batch.column(2)[k].as_py(), "<i4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()), ids, pa.array(n)], names=["block", "row", "doc_id", "n_words"])

    found = every.groupBy("block", "row").applyInArrow(merge, "block long, row int, n_hit long, n_items long, items_sha256 string")
    rows = index.select("block", "ids", "counts").mapInArrow(counts, f"block long, row int, doc_id {id_type}, n_words long").join(found, ["block", "row"], "left")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.lit(_summary(0, set())[2])).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def _found(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[tuple[int, pa.Array, Block, np.ndarray, np.ndarray, list[set[str]]]]:
    """Of each row of the index: its block, ids, postings, whether each position is inside a hit, hits and items of each document."""
    for batch in batches:
        for k in range(len(batch)):
            own = Block(*(batch.column(c)[k].as_py() for c in range(2, 6)))
            w, place = own.phrases(windows)
            n = len(own.counts)
            hit, items, inside = np.zeros(n, np.int64), [set() for _ in range(n)], np.zeros(0, bool)
            if len(w):
                inside, pairs = own.covered(windows, w, place)
                sums = np.concatenate([[0], np.cumsum(inside)])
                hit = sums[own.starts[1:]] - sums[own.starts[:-1]]
                for d, i in pairs.tolist():
                    if windows.names[i] is not None:
                        items[d].add(windows.names[i])
            yield batch.column(0)[k].as_py(), batch.column(1)[k].values, own, inside, hit, items


def _answers(index: DataFrame, shared, schema: str) -> DataFrame:
    """The answers where the benchmark is one part."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, own, _, hit, items in _found(batches, shared.value):
            found = [_summary(h, i) for h, i in zip(hit.tolist(), items, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.counts), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))), pa.array([f[0] > 0 for f in found], pa.bool_())], names=_names())

    return index.mapInArrow(lambda batches: released(apply(batches)), schema)


def _hits(index: DataFrame, shared) -> DataFrame:
    """block, row, hits (a bit for each word), items of the documents that one part of the benchmark hits."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, own, inside, hit, items in _found(batches, shared.value):
            rows = np.flatnonzero(hit).tolist()
            bits = [np.packbits(inside[own.starts[r] : own.starts[r] + own.counts[r]]).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array(bits, pa.binary()), pa.array([sorted(items[r]) for r in rows], pa.list_(pa.string()))], names=["block", "row", "hits", "items"])

    return index.mapInArrow(apply, "block long, row int, hits binary, items array<string>")


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int) -> DataFrame:
    """doc_id, item_id, word: places of an item window's rarest word near which all of its words lie (one row each)."""
    spark, index = docs.sparkSession, staged(build_index(docs), "index")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string, word long"
    found = None
    for items in _parts(benchmark)[1]:
        shared = spark.sparkContext.broadcast(Windows.of(items))

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for batch in batches:
                for k in range(len(batch)):
                    own = Block(*(batch.column(c)[k].as_py() for c in range(2, 6)))
                    w, place = own.near(asked, slop)
                    row = np.searchsorted(own.starts, place, side="right") - 1
                    out = sorted({(int(r), asked.names[i], int(p - own.starts[r])) for x, r, p in zip(w, row, place, strict=True) for i in asked.items[asked.first[x] : asked.first[x + 1]] if asked.names[i] is not None})
                    yield pa.RecordBatch.from_arrays([batch.column(1)[k].values.take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], names=["doc_id", "item_id", "word"])

        one = index.mapInArrow(apply, schema)
        found = one if found is None else found.union(one)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops the documents that hold a window of the benchmark.

    Rows are told apart by their id and a hash of their text, so null and repeated ids keep a verdict for each text.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("row")).alias("doc_id"), "text")
    with temporary(docs.sparkSession):
        found = contamination(rows, benchmark).filter("contaminated")
        gone = staged(found.select(F.col("doc_id.doc_id").alias("gone"), F.col("doc_id.row").alias("gone_row")).distinct(), "contaminated", keep=True)
    side = F.broadcast(gone) if gone.count() * 24 <= BROADCAST_BYTES else gone
    return docs.join(side, docs.doc_id.eqNullSafe(F.col("gone")) & (F.xxhash64(docs.text) == F.col("gone_row")), "left_anti")
