"""Approximate nearest neighbours: a forest of random-projection trees, a shared priority queue, exact reranking.

Equal vectors are one class (up to a power of two, which leaves a cosine as it is), with its smallest ids: a query's ``k`` nearest rows can't need more of
them. The trees are fitted on a sample of at most ``SAMPLE_BYTES`` of classes; each node cuts at the median of the projections on the difference
of two of its points. Every class is stored in one leaf of each tree. A query takes leaves from all trees by one priority queue, nearest
cuts first, until it has seen its budget of rows: the budget is a share of all rows, the least one with which queries of the sample find
``TARGET`` of their true neighbours among the sample. Leaves and the queries that ask them meet in units of bounded size (large leaves and
long lists of queries are cut, and every part meets every other); a unit compares blocks as matrices and scores what may be among the first again,
in double precision on the vectors themselves.

A vector that is null, zero, or holds null or non-finite components takes no part. Shorter vectors count as padded with zeros. Every row is a candidate
but the query's own: rows that repeat one are candidates and queries of their own. A null id never asks and comes last among ties. An empty
table gives no row, a query without candidates none; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import staged

K, EVERY = 5, 50
TREES, TARGET = 4, 0.98
#: Of the sample the trees are fitted on, and the queries of the sample that set the budget.
SAMPLE_ROWS, SAMPLE_BYTES, ASKED = 1 << 14, 64 << 20, 256
#: Rows that a leaf should have, the least number of leaves, and the points of the sample that a leaf needs.
LEAF_ROWS, LEAST_LEAVES, LEAF_POINTS = 1 << 15, 64, 16
#: Rows and queries of a unit, and products that are held at once.
UNIT_ROWS, UNIT_QUERIES, PRODUCTS = 1 << 16, 1 << 15, 1 << 21
#: What a product of rounded unit vectors may be off.
SLACK = 1e-9
LAST = np.iinfo(np.int64).max
NEAR = "qkey binary, ckey binary, score double, least long"


def vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, key, vec: the valid vectors as bytes of doubles, scaled by a power of two, and a digest of those."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            of, cuts, out = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False)), column.drop_null(), []
            values = pc.fill_null(cuts.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) + 0.0
            ends = np.cumsum(pc.list_value_length(cuts).to_numpy(zero_copy_only=False)) if len(cuts) else np.zeros(0, np.int64)
            for row, a, b in zip(of.tolist(), np.concatenate([[0], ends[:-1]]).astype(int).tolist() if len(ends) else [], ends.astype(int).tolist(), strict=True):
                own = values[a:b]
                most = np.abs(own).max(initial=0.0)
                if 0 < most < np.inf:  # false for nan
                    raw = np.ldexp(own, -int(np.frexp(most)[1])).tobytes()
                    out.append((row, xxhash.xxh3_128_digest(raw), raw))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["id", "key", "vec"])

    return rows.select(F.col(vec_id).cast("long").alias("id"), embedding).mapInArrow(apply, "id long, key binary, vec binary")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """key, vec, least, ids: each distinct vector with its k + 1 smallest ids (null ones last)."""
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("id"))
    first = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    return first.groupBy("key").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("ids"))


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of bytes as rows, padded with zeros."""
    if all(len(x) == 8 * dim for x in raw):
        return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    return np.frombuffer(b"".join(x.ljust(8 * dim, b"\x00") for x in raw), np.float64).reshape(-1, dim)


def units_of(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Forest:
    """Complete binary trees of one depth, their nodes in heap order; the leaves of all trees are numbered on."""

    def __init__(self, points: np.ndarray, depth: int, trees: int = TREES, seed: int = 0):
        r, n, dim = np.random.default_rng(seed), (1 << depth) - 1, points.shape[1]
        self.depth, self.trees, self.inner = depth, trees, n
        self.normals, self.offsets = np.zeros((trees, n, dim)), np.zeros((trees, n))
        for t in range(trees):
            held = {0: np.arange(len(points))}
            for node in range(n):
                own = held.pop(node)
                a, b = points[r.choice(own, 2)] if len(own) else np.zeros((2, dim))
                normal = a - b if np.any(a != b) else r.normal(size=dim)
                self.normals[t, node] = normal / np.sqrt((normal * normal).sum())
                at = points[own] @ self.normals[t, node]
                self.offsets[t, node] = np.median(at) if len(own) else 0.0
                right = at >= self.offsets[t, node]
                held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
        self.leaves = trees << depth

    def places(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((self.trees, len(x)), np.int64)
        for t in range(self.trees):
            for _ in range(self.depth):
                node = out[t]
                out[t] = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[t, node]) >= self.offsets[t, node])
            out[t] += (t << self.depth) - self.inner
        return out

    def search(self, x: np.ndarray) -> Iterator[Iterator[int]]:
        """Of each row, the leaves of all trees by one queue: a leaf is as far as the farthest cut on its way, and a cut is the nearer the deeper the row lies on the leaf's side."""
        for at in range(0, len(x), 4096):
            some = x[at : at + 4096]
            margins = (some @ self.normals.reshape(-1, x.shape[1]).T).reshape(len(some), self.trees, self.inner) - self.offsets
            for own in margins:
                yield self._queue(own)

    def _queue(self, margin: np.ndarray) -> Iterator[int]:
        queue = [(-np.inf, t, 0) for t in range(self.trees)]
        while queue:
            far, t, node = heapq.heappop(queue)
            if node >= self.inner:
                yield (t << self.depth) + node - self.inner
                continue
            m = float(margin[t, node])
            right = m >= 0
            heapq.heappush(queue, (max(far, -abs(m)), t, 2 * node + 1 + right))
            heapq.heappush(queue, (max(far, abs(m)), t, 2 * node + 2 - right))


def budget_share(forest: Forest, points: np.ndarray, k: int, target: float = TARGET, asked: int = ASKED) -> float:
    """The least share of the sample's rows, counted in each leaf, with which the first ``asked`` of them find ``target`` of their k nearest."""
    n = min(asked, len(points))
    near = points[:n] @ points.T
    near[np.arange(n), np.arange(n)] = -np.inf
    k = min(k, len(points) - 1)
    if k < 1:
        return float(forest.trees)
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    places = forest.places(points)
    rows = np.bincount(places.ravel(), minlength=forest.leaves)
    costs = []
    for own, leaves in zip(true, forest.search(points[:n]), strict=True):
        where: dict[int, set[int]] = {}
        for i in own.tolist():
            for leaf in places[:, i].tolist():
                where.setdefault(leaf, set()).add(i)
        missing, seen = set(own.tolist()), 0
        for leaf in leaves:
            seen += int(rows[leaf])
            costs += [seen] * len(missing & where.get(leaf, set()))
            missing -= where.get(leaf, set())
            if not missing:
                break
    return float(np.sort(costs)[max(0, int(np.ceil(target * len(costs))) - 1)] / len(points))


def _grouped(leaf: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """A row for each leaf: the leaf, the kind, how many, and the bytes of its part of the columns."""
    order = np.argsort(leaf, kind="stable")
    cuts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        mine = order[a:b]
        yield int(leaf[mine[0]]), kind, len(mine), b"".join(np.ascontiguousarray(c[mine]).tobytes() for c in columns)


PARTS = "leaf int, kind int, n long, blob binary"


def _parts(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["leaf", "kind", "n", "blob"])


def stored(rows: DataFrame, shared, dim: int) -> DataFrame:
    """The classes in the leaves of each tree: digests, least ids and vectors."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1).to_pylist(), dim)
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
            least = pc.fill_null(batch.column(2), LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            yield _parts([r for leaf in forest.places(units_of(x)) for r in _grouped(leaf, 0, key, least, x)])

    return rows.select("key", "vec", "least").mapInArrow(apply, PARTS)


def asking(rows: DataFrame, shared, dim: int, populations, budget: int) -> DataFrame:
    """The queries in the leaves that they ask: digests and vectors."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rows_of = shared.value, populations.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.slice(at, 2048)
                x = matrix(some.column(1).to_pylist(), dim)
                key = np.frombuffer(b"".join(some.column(0).to_pylist()), "V16")
                owner, leaf = [], []
                for i, leaves in enumerate(forest.search(units_of(x))):
                    seen = 0
                    for one in leaves:
                        owner.append(i)
                        leaf.append(one)
                        seen += int(rows_of[one])
                        if seen >= budget:
                            break
                owner = np.array(owner, np.int64)
                yield _parts(list(_grouped(np.array(leaf, np.int64), 1, key[owner], x[owner])))

    return rows.select("key", "vec").mapInArrow(apply, PARTS)


def first_of(query: np.ndarray, score: np.ndarray, least: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's first k candidates: by score, then by least id, then by digest; a class counts once."""
    order = np.lexsort((key.view(">u8").reshape(-1, 2)[:, 1], key.view(">u8").reshape(-1, 2)[:, 0], least, -score, query))
    same = np.zeros(len(order), bool)
    same[1:] = (query[order[1:]] == query[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    order = order[~same]
    head = np.flatnonzero(np.diff(query[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order)))) < k]


class Unit:
    """A block of queries that meets the rows of a leaf, part by part."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k = dim, k
        self.keys: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []

    def ask(self, n: int, blob: bytes) -> None:
        self.keys.append(np.frombuffer(blob, "V16", n))
        self.rows.append(np.frombuffer(blob, np.float64, n * self.dim, 16 * n).reshape(n, self.dim))

    def begin(self) -> None:
        self.key, self.x = np.concatenate(self.keys), np.concatenate(self.rows)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.unit = self.x / self.norm[:, None]
        self.worst = np.full(len(self.x), -np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, "V16"))

    def meet(self, n: int, blob: bytes) -> None:
        key, least = np.frombuffer(blob, "V16", n), np.frombuffer(blob, np.int64, n, 16 * n)
        x = np.frombuffer(blob, np.float64, n * self.dim, 24 * n).reshape(n, self.dim)
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / norm[:, None]
        step = max(1, PRODUCTS // n)
        for a in range(0, len(self.x), step):
            near = self.unit[a : a + step] @ unit.T
            bound = self.worst[a : a + step]
            if n > self.k:
                bound = np.maximum(bound, np.partition(near, n - self.k, axis=1)[:, n - self.k])
            q, c = np.nonzero(near >= bound[:, None] - SLACK)
            if len(q):
                q = a + q
                parts = [slice(i, i + PRODUCTS // 64) for i in range(0, len(q), PRODUCTS // 64)]
                score = np.concatenate([(self.x[q[p]] * x[c[p]]).sum(axis=1) / (self.norm[q[p]] * norm[c[p]]) for p in parts])
                self._take(q, score, least[c], key[c])

    def _take(self, *new: np.ndarray) -> None:
        touched = np.zeros(len(self.x), bool)
        touched[new[0]] = True
        again = touched[self.found[0]]
        both = [np.concatenate([old[again], fresh]) for old, fresh in zip(self.found, new, strict=True)]
        kept = first_of(*both, self.k)
        both = [c[kept] for c in both]
        count = np.bincount(both[0], minlength=len(self.x))
        full = count >= self.k
        low = np.full(len(self.x), np.inf)
        np.minimum.at(low, both[0], both[1])
        self.worst[full] = low[full]
        self.found = tuple(np.concatenate([old[~again], fresh]) for old, fresh in zip(self.found, both, strict=True))


def met(units: DataFrame, dim: int, k: int, held: int = 1 << 19) -> DataFrame:
    """The first k + 1 classes of each query of each unit: ``units`` has the parts of a unit together, queries first. What a task finds for one query in several units is merged."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []

        def taken() -> pa.RecordBatch:
            qkey, score, least, ckey = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            _, query = np.unique(qkey.view(">u8").reshape(-1, 2), axis=0, return_inverse=True)
            at = first_of(query.ravel().astype(np.int64), score, least, ckey, k + 1)
            return pa.RecordBatch.from_arrays([_digests(qkey[at]), _digests(ckey[at]), pa.array(score[at]), pa.array(least[at])], names=["qkey", "ckey", "score", "least"])

        def closed(unit: Unit | None) -> None:
            if unit is not None and unit.keys and hasattr(unit, "found") and len(unit.found[0]):
                query, score, least, key = unit.found
                waiting.append((unit.key[query], score, least, key))

        unit, own = None, None
        for batch in batches:
            for leaf, sub, block, kind, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != (leaf, sub, block):
                    closed(unit)
                    unit, own = Unit(dim, k + 1), (leaf, sub, block)
                    if sum(len(w[0]) for w in waiting) > held:
                        yield taken()
                if kind:
                    unit.ask(n, blob)
                elif unit.keys:  # a leaf that no query asks is passed over
                    if not hasattr(unit, "found"):
                        unit.begin()
                    unit.meet(n, blob)
        closed(unit)
        if waiting:
            yield taken()

    return units.select("leaf", "sub", "block", "kind", "n", "blob").mapInArrow(apply, NEAR)


def _digests(keys: np.ndarray) -> pa.Array:
    return pa.array([bytes(x) for x in keys], pa.binary())


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding", asks: Column | None = None, target: float = TARGET, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by ``every`` (or for which ``asks``, of ``id``, holds), the k rows found of largest cosine."""
    spark = rows.sparkSession
    valid = staged(vectors(rows, vec_id, embedding), "vectors")
    queries = valid.filter(F.col("id") % every == 0 if asks is None else asks)
    of = staged(classes(valid, k), "classes")
    n, dim = of.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    dim //= 8
    most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    points = units_of(matrix([bytes(r["vec"]) for r in of.orderBy("key").limit(most).select("vec").collect()], dim))
    wanted = max(LEAST_LEAVES, -(-n // LEAF_ROWS))
    depth = max(0, min((wanted - 1).bit_length(), (len(points) // LEAF_POINTS).bit_length() - 1))
    forest = Forest(points, depth, trees)
    budget = int(np.ceil(budget_share(forest, points, k, target) * n))
    shared = spark.sparkContext.broadcast(forest)
    index = staged(stored(of, shared, dim), "leaves")
    sizes = np.zeros(forest.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    asked = staged(asking(queries.dropDuplicates(["key"]), shared, dim, spark.sparkContext.broadcast(sizes), budget), "asked")
    many = np.zeros(forest.leaves, np.int64)
    for r in asked.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        many[r["leaf"]] = r["n"]
    subs, blocks = np.maximum(1, -(-sizes // UNIT_ROWS)), np.maximum(1, -(-many // UNIT_QUERIES))
    count = lambda x: F.get(F.array(*[F.lit(int(v)) for v in x]) if len(set(x.tolist())) > 1 else F.array_repeat(F.lit(int(x[0])), len(x)), F.col("leaf"))
    number = F.monotonically_increasing_id()
    left = index.filter(F.get(F.lit(many.tolist()), F.col("leaf")) > 0).select("*", (number % count(subs)).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), count(blocks) - 1)).alias("block"))
    right = asked.select("*", F.explode(F.sequence(F.lit(0), count(subs) - 1)).alias("sub"), (number % count(blocks)).cast("int").alias("block"))
    both = left.select("leaf", "sub", "block", "kind", "n", "blob").unionByName(right.select("leaf", "sub", "block", "kind", "n", "blob"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((subs * blocks).sum()) // 8)
    units = both.repartition(tasks, "leaf", "sub", "block").sortWithinPartitions("leaf", "sub", "block", F.desc("kind"))
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "least", "ckey")
    best = met(units, dim, k).dropDuplicates(["qkey", "ckey"]).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    ids = best.join(of.select(F.col("key").alias("ckey"), "ids"), "ckey").select("qkey", "score", (F.col("qkey") == F.col("ckey")).alias("own"), F.explode("ids").alias("id"))
    near = ids.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), "own"))).alias("near"))
    # of its own class, the query's row goes once
    mine = F.array_position(F.transform("near", lambda x: F.coalesce(x["own"] & (x["id"] == F.col("query_id")), F.lit(False))), True)
    found = queries.select(F.col("id").alias("query_id"), F.col("key").alias("qkey")).join(near, "qkey")
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("_mine")), 1, k)
    return found.withColumn("_mine", mine).select("query_id", F.posexplode(others).alias("_at", "x")).select("query_id", (F.col("_at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
