"""Links between texts that share most of their word shingles: SimHash components and MinHash bands propose pairs, whole shingle sets decide.

A text's set is that of the 64-bit hashes of its ``WORDS``-word shingles (all of its words, if they are fewer); texts of equal
sets are one class, keyed by a hash of the whole set. ``BANDS`` bands of ``ROWS`` least hashes each bring together the classes
that agree in a band: a pair of Jaccard similarity J is missed with probability (1 - J^ROWS)^BANDS, which is 6e-5 at
J = 0.8, 4e-7 at 0.85 and less above. The sets of the classes that share a band are written to mapped files, and a link
asks that the exact similarity is ``SIMILARITY`` or more. A band returns a spanning forest of its links, never all pairs.

A large band is not compared pair by pair. Its shingles are ordered from rare to common; two sets as similar as asked share one of the
first shingles of each, and where they meet for the first time leaves enough of both (the prefix and positional filters of
set joins, which lose nothing). Classes come in the order of how common their shingles are, so that the middle of a group is joined first
and what it has joined is not compared again. A band of more than ``BLOCK`` classes is cut into blocks, and every two blocks meet in a task.

A text without words has the empty set, which is linked to nothing but itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import simhash_vp
from strandlake.llm.components import components
from strandlake.llm.arrays import dealt, mapped, new_folder, save
from strandlake.llm.text import mix, prefix_hash, released, span_hash
from strandlake.session import staged, temporary

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Words whose shingles are hashed at once.
CHUNK_WORDS = 1 << 18
#: Shingles that are permuted, and that are compared, at once.
PERMUTED, COMPARED = 2048, 1 << 20
#: Bytes that a task or file should hold.
TASK_BYTES = 48 << 20
#: Bytes of ids that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Classes that a task remembers to have sent.
REMEMBERED = 1 << 20
#: Classes of a band that are compared pair by pair; classes of a band that meet in one task.
SMALL, BLOCK = 24, 1 << 13

_FACTORS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _ends(work):
    """``work`` over a task's batches, after which the worker gives memory back."""
    return lambda batches: released(work(batches))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = []
    for at in range(0, max(1, len(words) - width + 1) if words else 0, CHUNK_WORDS):
        some = words[at : at + CHUNK_WORDS + width - 1]
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(some) - width + 1)
        out.append(span_hash(prefix_hash(np.frombuffer(b" ".join(some), np.uint8)), starts[:n], ends[width - 1 :] if len(some) >= width else ends[-1:]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def key_of(own: np.ndarray) -> int:
    """The key of a set of shingles, as a signed long."""
    value = xxhash.xxh64_intdigest(own.tobytes(), 42)
    return value - (1 << 64) if value >> 63 else value


def bands(own: np.ndarray) -> np.ndarray:
    """The hash of each band of a set of shingles."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = own.astype(np.uint32)
    for at in range(0, len(low), PERMUTED):
        np.minimum(least, (low[at : at + PERMUTED, None] * _FACTORS).min(axis=0), out=least)
    h = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for row in least.reshape(BANDS, ROWS).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + row)
    return h


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), key, n (shingles) and bands; bands is null where the task sent those of the key before."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                keys, sizes, out = [], [], []
                for text in some.column(2):
                    own = shingles(text.as_py())
                    keys.append(key_of(own))
                    sizes.append(len(own))
                    new = len(own) and keys[-1] not in sent
                    out.append(bands(own).tobytes() if new else None)
                    if new and len(sent) < REMEMBERED:
                        sent.add(keys[-1])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "row", "key", "n", "bands"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(_ends(apply), rows.select("doc_id", "row").schema.add("key", "long").add("n", "long").add("bands", "binary"))


def with_simhash(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``classes`` whose rows also have their SimHash component as a band, if it has other texts: its classes are then compared as those of any band are."""
    own = staged(simhash_vp.near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text")).select("doc_id", "component_id").distinct(), "simhash")
    shared = own.groupBy("component_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("component_id")
    band = own.join(shared, "component_id").select(F.col("doc_id").alias("_row"), F.unhex(F.lpad(F.hex("component_id"), 16, "0")).alias("_band"))
    both = found.join(band, F.col("row") == F.col("_row"), "left")
    # texts of one set may lie in several components, so a row has that band even where its task sent the set's bands before
    return both.withColumn("bands", F.when(F.col("_band").isNull() | (F.col("n") == 0), F.col("bands")).otherwise(F.concat(F.coalesce("bands", F.lit(b"")), "_band"))).drop("_row", "_band")


def blocked(start: int, end: int) -> Iterator[list[tuple[int, int]]]:
    """The runs of a band that meet: itself, or every two of its blocks."""
    if end - start <= BLOCK:
        yield [(start, end)]
        return
    half = BLOCK // 2
    cuts = [(s, min(end, s + half)) for s in range(start, end, half)]
    for i in range(len(cuts)):
        for j in range(i + 1, len(cuts)):
            yield [cuts[i], cuts[j]]


def _dealt(marked: DataFrame, tasks: int) -> DataFrame:
    """first, members: the classes of each band that has two or more, sorted."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.repeat(batch.column(0).to_numpy(), pc.binary_length(batch.column(1)).to_numpy() // 8)
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            task = (h % np.uint64(tasks)).astype(np.int32)
            order = np.argsort(task, kind="stable")
            pairs = np.stack([h[order], keys[order].view(np.uint64)], axis=1)
            own, first = np.unique(task[order], return_index=True)
            blobs = [p.tobytes() for p in np.split(pairs, first[1:])] if len(own) else []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["task", "pairs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for task, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(task, []).append(blob)
        while held:
            _, blobs = held.popitem()
            pairs = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
            h, keys = pairs[:, 0], pairs[:, 1].view(np.int64)
            order = np.lexsort((keys, h))
            h, keys = h[order], keys[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (keys[1:] != keys[:-1])
            h, keys = h[new], keys[new]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends = np.append(starts[1:], len(h))
            many = ends - starts > 1
            runs_ = [pieces for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True) for pieces in blocked(s, e)]
            for at in range(0, len(runs_), 4096):
                some = runs_[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([keys[p[0][0]] for p in some], pa.int64()), pa.array([b"".join(keys[s:e].tobytes() for s, e in p) for p in some], pa.binary())], names=["first", "members"])

    known = marked.filter("bands IS NOT NULL").select("key", "bands")
    return dealt(known.mapInArrow(_ends(deal), "task int, pairs binary"), tasks, "task").mapInArrow(_ends(gather), "first long, members binary").dropDuplicates(["members"])


class Sets:
    """Mapped sets of shingles by key, in files by ranges of the key; only of the classes that are asked for."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.edges = folder, (np.arange(shards, dtype=object) * (1 << 64) // shards - (1 << 63)).astype(np.int64)
        #: Array lengths by shard: keys asked for, keys stored, shingles stored.
        self.sizes = np.zeros((shards, 3), np.int64)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, keys, side="right") - 1

    def wanted(self, key: int) -> bool:
        k = self.shard(np.array([key]))[0]
        known = mapped(self.folder, f"wanted-{k}", int(self.sizes[k, 0]))
        at = np.searchsorted(known, key)
        return at < len(known) and known[at] == key

    def of(self, key: int) -> np.ndarray:
        k = self.shard(np.array([key]))[0]
        n = int(self.sizes[k, 1])
        at = np.searchsorted(mapped(self.folder, f"keys-{k}", n), key)
        offsets = mapped(self.folder, f"offsets-{k}", n + 1)
        return mapped(self.folder, f"sets-{k}", int(self.sizes[k, 2]))[offsets[at] : offsets[at + 1]]

    @classmethod
    def write(cls, docs: DataFrame, groups: DataFrame, shards: int) -> Sets:
        spark = docs.sparkSession
        made = cls(new_folder(spark, "sets"), shards)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))
                at, first = np.unique(made.shard(keys), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([k.tobytes() for k in np.split(keys, first[1:])] if len(at) else [], pa.binary())], names=["shard", "keys"])

        def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            for batch in batches:
                for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(k, []).append(blob)
            found = {k: np.unique(np.frombuffer(b"".join(blobs), np.int64)) for k, blobs in held.items()}
            for k, keys in found.items():
                save(made.folder, f"wanted-{k}", keys)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([len(x) for x in found.values()], pa.int64())], names=["shard", "n"])

        for r in dealt(groups.select("members").mapInArrow(ask, "shard int, keys binary"), shards).mapInArrow(_ends(note), "shard int, n long").collect():
            made.sizes[r["shard"], 0] = r["n"]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: set[int] = set()
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    keys, sets = [], []
                    for text in batch.column(0).slice(at, 1024):
                        own = shingles(text.as_py())
                        key = key_of(own)
                        if key not in sent and made.wanted(key):
                            keys.append(key)
                            sets.append(own.tobytes())
                            if len(sent) < REMEMBERED:
                                sent.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array(made.shard(np.array(keys, np.int64)), pa.int32()), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["shard", "key", "shingles"])

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, dict[int, bytes]] = {}
            for batch in batches:
                for k, key, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.setdefault(k, {})[key] = own
            done = []
            while held:
                k, own = held.popitem()
                keys = sorted(own)
                done.append((k, len(keys), sum(map(len, own.values())) // 8))
                save(made.folder, f"keys-{k}", np.array(keys, np.int64))
                save(made.folder, f"offsets-{k}", np.concatenate([[0], np.cumsum([len(own[x]) // 8 for x in keys])]).astype(np.int64))
                save(made.folder, f"sets-{k}", np.frombuffer(b"".join(own[x] for x in keys), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], names=["shard", "n", "total"])

        for r in dealt(docs.select("text").mapInArrow(_ends(send), "shard int, key long, shingles binary"), shards).mapInArrow(_ends(store), "shard long, n long, total long").collect():
            made.sizes[r["shard"], 1:] = r["n"], r["total"]
        return made


def alike(one: np.ndarray, others: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Which of the other sets have that exact Jaccard similarity to ``one`` or more."""
    out, sizes = np.zeros(len(others), bool), np.array([len(o) for o in others], np.int64)
    # sets whose sizes differ by more can't be similar enough
    left = np.flatnonzero(np.minimum(sizes, len(one)) >= least * np.maximum(sizes, len(one)))
    cut = np.searchsorted(np.cumsum(sizes[left]), np.arange(COMPARED, int(sizes[left].sum()) + COMPARED, COMPARED)) + 1
    for some in np.split(left, np.unique(cut[cut < len(left)])):
        if len(some):
            own = np.concatenate([others[i] for i in some])
            hit = one[np.minimum(np.searchsorted(one, own), len(one) - 1)] == own
            shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            out[some] = shared >= least * (len(one) + sizes[some] - shared)
    return out


class Joined:
    """Which classes a task has already linked, directly or not: those need no second test."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def compared(members: list[int], sets: Sets, joined: Joined, least: float) -> list[tuple[int, int]]:
    """Links that span the components of a small band, by comparing each class with those after it that are not joined to it."""
    out, held = [], {}
    for i, one in enumerate(members):
        top = joined.find(one)
        rest = [x for x in members[i + 1 :] if joined.find(x) != top]
        if rest:
            for x in (one, *rest):
                if x not in held:
                    held[x] = sets.of(x)
            for x, hit in zip(rest, alike(held[one], [held[x] for x in rest], least).tolist(), strict=True):
                if hit and joined.find(x) != joined.find(one):
                    joined.link(x, one)
                    out.append((x, one))
    return out


def filtered(members: list[int], own: list[np.ndarray], joined: Joined, least: float) -> list[tuple[int, int]]:
    """The same for a large band, through its rare shingles."""
    sizes = np.array([len(o) for o in own], np.int64)
    owner = np.repeat(np.arange(len(own)), sizes)
    _, shingle, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    # the middle of a group first: classes with few rare shingles
    rank = np.empty(len(own), np.int64)
    rank[np.argsort(np.bincount(owner, weights=1.0 / often[shingle], minlength=len(own)), kind="stable")] = np.arange(len(own))
    place = np.empty(len(often), np.int64)
    place[np.argsort(often, kind="stable")] = np.arange(len(often))
    order = np.lexsort((place[shingle], rank[owner]))
    owner, shingle = rank[owner][order], place[shingle][order]
    by_rank = np.argsort(rank)
    sizes = sizes[by_rank]
    position = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Fractions like 0.8 are not exact: a slack keeps what lies on the edge.
    prefix = position < sizes[owner] - np.ceil(least * sizes[owner] - 1e-9) + 1
    owner, shingle, position = owner[prefix], shingle[prefix], position[prefix]
    listed = np.argsort(shingle, kind="stable")
    by_shingle, in_list, at_list = shingle[listed], owner[listed], position[listed]
    low, high = np.searchsorted(by_shingle, shingle), np.searchsorted(by_shingle, shingle, side="right")
    first = np.searchsorted(owner, np.arange(len(own) + 1))
    out = []
    for x in range(1, len(own)):
        a, b = low[first[x] : first[x + 1]], high[first[x] : first[x + 1]]
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other, mine = in_list[at], np.repeat(position[first[x] : first[x + 1]], n)
        need = np.ceil(least / (1 + least) * (sizes[x] + sizes[other]) - 1e-9)
        asked = np.unique(other[(other < x) & (1 + np.minimum(sizes[x] - mine, sizes[other] - at_list[at]) - 1 >= need)]).tolist()
        me, step = members[by_rank[x]], 1
        while asked:
            asked = [y for y in asked if joined.find(members[by_rank[y]]) != joined.find(me)]
            some, asked, step = asked[:step], asked[step:], min(step * 8, 512)
            if some:
                for y, hit in zip(some, alike(own[by_rank[x]], [own[by_rank[y]] for y in some], least).tolist(), strict=True):
                    if hit and joined.find(members[by_rank[y]]) != joined.find(me):
                        joined.link(me, members[by_rank[y]])
                        out.append((me, members[by_rank[y]]))
    return out


def links(docs: DataFrame, marked: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b: links that span the components of the classes of ``marked`` (staged ``classes`` of ``docs``) at that similarity."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, total = marked.agg(F.count("bands"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = staged(_dealt(marked, max(partitions, rows * BANDS * 16 // TASK_BYTES + 1)), "bands")
    sets = Sets.write(docs, groups, max(partitions, total * 8 // TASK_BYTES + 1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for blob in batch.column(1).to_pylist():
                members = np.frombuffer(blob, np.int64).tolist()
                if len(members) <= SMALL:
                    found += compared(members, sets, joined, least)
                elif len({joined.find(x) for x in members}) > 1:
                    found += filtered(members, [sets.of(x) for x in members], joined, least)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return groups.repartition(max(partitions, rows * BANDS * 8 // TASK_BYTES + 1), "first").mapInArrow(_ends(compare), "a long, b long")


def keep_first(docs: DataFrame) -> DataFrame:
    """Keeps one document of each group of similar documents, that with the smallest id.

    Rows are told apart by their id and a hash of their text, so null and repeated ids keep a verdict for each text; a null id is
    the largest. Of rows that agree in both, which are in one group, one stays. Only those columns are compared: the texts move only
    when so many documents go that their ids can't be broadcast, or when such rows repeat.
    """
    with temporary(docs.sparkSession):
        marked = staged(with_simhash(docs, classes(docs)), "classes")
        roots = components(links(docs, marked))
        placed = staged(marked.join(roots, marked.key == roots.node, "left").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("at"), F.coalesce("root", "key").alias("root")), "placed")
        heads = placed.groupBy("root").agg(F.min("at").alias("head"), F.count("*").alias("n")).filter("n > 1")
        grouped = staged(placed.join(heads, "root").select("at", "head"), "grouped")
        gone = staged(grouped.filter("NOT (at <=> head)").select(F.col("at.doc_id").alias("gone"), F.col("at.row").alias("gone_row")).distinct(), "gone", keep=True)
        repeated = grouped.filter("at <=> head").groupBy("at").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    side = F.broadcast(gone) if gone.count() * 24 <= BROADCAST_BYTES else gone
    rows = docs.withColumn("strandlake_row", F.xxhash64("text"))
    kept = rows.join(side, rows.doc_id.eqNullSafe(F.col("gone")) & (rows.strandlake_row == F.col("gone_row")), "left_anti")
    return (kept.dropDuplicates(["doc_id", "strandlake_row"]) if repeated else kept).drop("strandlake_row")
