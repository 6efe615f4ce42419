"""SimHash near-duplicates: exact links at small Hamming distance through sharded vantage-point trees.

Each text gets a 64-bit SimHash of its word shingles (XXH64, seed 42). Equal fingerprints form one class. If the bits are cut
into ``parts``, two fingerprints within ``radius`` bits agree within ``radius // parts`` bits in some part, and Hamming
distance is a metric on each part, so there is one vantage-point tree for each part. A tree is fitted on a bounded
sample of fingerprints; its leaves are shards. A fingerprint is stored in the one leaf that its own distances
lead to, and it also queries every leaf whose side of a vantage sphere its ball overlaps (the triangle bound prunes
the rest), so the two members of any linking pair meet in a shard. There the whole 64 bits are compared, and a
shard returns a spanning forest of its links, never all pairs. Components follow by alternating stars in Spark.

A tree is fitted on a bounded sample, so its leaves grow with the table; a shard that stores more than ``OVERFULL`` leaves' worth is cut again
by a tree of its own, inside its task and with the same bounds.

A null text is empty; a text without words has fingerprint zero. Repeated rows come back as often as they came, all
with one component. A null doc_id is never the smallest, and a component of null ids alone has a null id.
An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.components import components
from strandlake.llm.text import released
from strandlake.session import staged

SEED = 42
SHINGLE = 3
RADIUS = 3
PARTS = 2
#: Distinct fingerprints on which a tree is fitted, at most.
SAMPLE = 16_384
#: Fingerprints that a leaf should store.
LEAF = 512
#: Leaves' worth of fingerprints beyond which a shard is cut again.
OVERFULL = 4
#: Words whose shingles are held at once.
CHUNK_WORDS = 1 << 18
#: Fingerprints that are routed at once.
ROUTED = 1 << 17
#: Cells of a distance matrix.
CELLS = 1 << 21


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set if over half of its shingles' hashes have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, total, votes = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    for at in range(0, max(1, len(words) - width + 1), CHUNK_WORDS):
        some = words[at : at + CHUNK_WORDS + width - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(some) - width + 1)
        last = ends[width - 1 :] if len(some) >= width else ends[-1:]
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1).slice(at, 1024)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(apply(batches)), docs.select("doc_id").schema.add("fp", "long"))


@dataclass
class Node:
    vantage: int = 0
    within: int = -1
    inner: Node | None = None
    outer: Node | None = None
    leaf: int = -1


class Tree:
    """A vantage-point tree over one part of the fingerprints' bits, of which only the routing is kept."""

    def __init__(self, shift: int, bits: int, sample: np.ndarray, rows: int, leaf: int, reach: int, seed: int = 7):
        self.shift, self.bits, self.reach, self.leaves = shift, bits, reach, 0
        self.random = np.random.default_rng(seed + shift)
        self.root = self._grow(self.part(sample), rows / max(1, len(sample)), leaf)

    def part(self, fps: np.ndarray) -> np.ndarray:
        return ((fps >> np.uint64(self.shift)) & np.uint64((1 << self.bits) - 1)).astype(np.uint32)

    def _grow(self, parts: np.ndarray, each: float, leaf: int) -> Node:
        best = None
        if len(parts) * each > leaf and len(parts) > 4:
            for _ in range(4):
                vantage = parts[self.random.integers(len(parts))]
                d = np.bitwise_count(parts ^ vantage)
                within = int(np.median(d))
                inside = int((d <= within).sum())
                # fewer points on the boundary, and an even split, make a better vantage point
                cost = ((d >= within - self.reach + 1) & (d <= within + self.reach)).sum() + abs(2 * inside - len(d))
                if 0 < inside < len(d) and (best is None or cost < best[0]):
                    best = (cost, vantage, within, d <= within)
        if best is None:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        _, vantage, within, inside = best
        return Node(int(vantage), within, self._grow(parts[inside], each, leaf), self._grow(parts[~inside], each, leaf))

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each leaf that is reached: its number, the rows that query it, and which of them it stores."""
        parts = self.part(fps)
        stack = [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            if node.inner is None:
                yield node.leaf, rows, home
                continue
            d = np.bitwise_count(parts[rows] ^ np.uint32(node.vantage)).astype(np.int16)
            low, high = d - self.reach <= node.within, d + self.reach > node.within
            stack.append((node.inner, rows[low], (home & (d <= node.within))[low]))
            stack.append((node.outer, rows[high], (home & (d > node.within))[high]))


def forest(stored: np.ndarray, asking: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a shard, each member hooked to the smallest of its tree."""
    step = max(1, CELLS // max(1, len(asking)))
    linked_a, linked_s = np.zeros(len(asking), bool), np.zeros(len(stored), bool)
    for at in range(0, len(stored), step):
        near = np.bitwise_count(stored[at : at + step, None] ^ asking[None, :]) <= radius
        near &= stored[at : at + step, None] != asking[None, :]
        linked_s[at : at + step] = near.any(axis=1)
        linked_a |= near.any(axis=0)
    left = np.union1d(stored[linked_s], asking[linked_a])

    def linked(front: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Which of the rows ``rest`` link to any of the rows ``front``."""
        step, found = max(1, CELLS // len(rest)), np.zeros(len(rest), bool)
        for at in range(0, len(front), step):
            open_ = np.flatnonzero(~found)
            found[open_] |= (np.bitwise_count(left[front[at : at + step], None] ^ left[rest[open_]][None, :]) <= radius).any(axis=0)
        return found

    a, b = [], []
    rest = np.arange(len(left))
    while len(rest):
        front, tree, rest = rest[:1], [rest[:1]], rest[1:]
        while len(front) and len(rest):
            found = linked(front, rest)
            front, rest = rest[found], rest[~found]
            tree.append(front)
        members = left[np.concatenate(tree)]
        if len(members) > 1:
            a.append(members[1:])
            b.append(np.full(len(members) - 1, members[0]))
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def shard_links(stored: np.ndarray, asking: np.ndarray, radius: int, shift: int, bits: int, reach: int, leaf: int, seed: int = 11) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The forests of a shard; an overfull one is cut by a tree of its own over the same part of the bits."""
    stored = np.unique(stored)
    if len(stored) > OVERFULL * leaf:
        picked = np.random.default_rng(seed).choice(stored, min(SAMPLE, len(stored)), replace=False)
        tree = Tree(shift, bits, picked, len(stored), leaf, reach, seed)
        if tree.leaves > 1:
            here = np.isin(asking, stored)
            for _, rows, home in tree.route(asking):
                own = asking[rows[home & here[rows]]]
                if len(own) < len(stored):
                    yield from shard_links(own, asking[rows], radius, shift, bits, reach, leaf, seed + 1)
                else:  # the tree does not part them
                    yield forest(own, asking[rows], radius)
            return
    if len(stored):
        yield forest(stored, asking, radius)


def links(classes: DataFrame, radius: int = RADIUS, parts: int = PARTS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """a, b: links that span the components of the distinct fingerprints ``fp`` at ``radius`` bits or fewer."""
    spark = classes.sparkSession
    rows = classes.count()
    picked = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    points = np.array([r["fp"] for r in picked], np.int64).view(np.uint64)
    cuts = [64 * k // parts for k in range(parts + 1)]
    trees = [Tree(low, high - low, points, rows, leaf, radius // parts) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    shared = spark.sparkContext.broadcast(trees)
    # a level of a tree sends a third or more of what reaches it to both sides; a ball of one bit reaches as many leaves as it has points at most
    sent = rows * parts * min(1.4 ** np.log2(max(2.0, rows / leaf)), 2.0 + 64 / parts) * 16
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sent / (24 << 20)) + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k, tree in enumerate(shared.value):
                out = [(leaf, fps[rows[home]].tobytes(), fps[rows].tobytes()) for leaf, rows, home in tree.route(fps)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(out), pa.int32()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["tree", "leaf", "stored", "asking"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(batch)
            if n >= ROUTED:
                yield from send(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from send(np.concatenate(held))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[tuple[int, int], list[list[bytes]]] = {}
        for batch in batches:
            for tree, leaf, stored, asking in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shards.setdefault((tree, leaf), [[], []])
                own[0].append(stored)
                own[1].append(asking)
        while shards:
            (k, _), own = shards.popitem()
            for a, b in shard_links(*(np.frombuffer(b"".join(x), np.uint64) for x in own), radius, cuts[k], cuts[k + 1] - cuts[k], radius // parts, leaf):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    routed = classes.select("fp").mapInArrow(lambda batches: released(route(batches)), "tree int, leaf int, stored binary, asking binary")
    return routed.repartition(tasks, "tree", "leaf").mapInArrow(lambda batches: released(compare(batches)), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    marked = staged(fingerprints(docs, width), "simhash")
    classes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = components(links(classes, radius, parts))
    members = staged(roots.join(classes, roots.node == classes.fp).select("fp", "root", "first"), "members")
    heads = members.groupBy("root").agg(F.min("first").alias("head"))
    linked = members.join(heads, "root").select("fp", "head")
    alone = classes.filter("n > 1").join(members.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("head"))
    known = linked.union(alone).select(F.col("fp").alias("key"), "head", F.lit(True).alias("grouped"))
    found = marked.join(known, marked.fp == known.key, "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("grouped"), F.col("head")).otherwise(F.col("doc_id")).alias("component_id"))
