"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Words (runs of letters and digits, in lower case, and runs of other signs) are hashed into ``BUCKETS`` buckets. Each bucket has
a fixed sparse ternary index vector; the context vector of a bucket is the sum of the index vectors of its left and right neighbours over all
documents, counted in Spark as integers of fixed width. A document's features are the means of its words' context and
index vectors, and a few plain statistics. The network is fitted on at most ``LABELLED`` labelled documents (those with the smallest
hashes of their ids); a fifth of them sets the temperature that calibrates its probabilities.

Null and empty texts have zero features and get the network's answer for those. Repeated rows are scored one by one; a null doc_id is
scored but never learnt from. Without labels of both classes every score is the share of label 1 (0.5 without any). Empty tables give no
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.arrays import planes
from strandlake.llm.langid import held_out
from strandlake.llm.text import LOWER, NOT_BLANK, WORD, blocks, prefix_hash, span_hash

BUCKETS, DIMS, NONZERO = 16384, 48, 4
#: Labelled documents that the network is fitted on, at most.
LABELLED = 20_000
#: Parts of the buckets' range, and partial sums that each part gets before the last one.
PARTS, LEVELS = 16, (6, 6)
#: Bytes of text whose word vectors are pooled at once.
POOLED_BYTES = 1 << 19
PLAIN = 8
WIDTH = 2 * DIMS + PLAIN
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 64, 3e-3, 1e-4


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the non-zero entries of each bucket's index vector."""
    random = np.random.default_rng(20)
    places = np.argsort(random.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO].astype(np.int64)
    return places, np.tile(np.array([1, -1] * (NONZERO // 2), np.int64), (BUCKETS, 1))


PLACES, SIGNS = index_vectors()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of a block's words, their lengths in bytes, and the first word of each text (n+1)."""
    low = LOWER[data]
    kind = np.where(WORD[low], 2, NOT_BLANK[low]).astype(np.int8)
    fresh = np.ones(len(kind) + 1, bool)
    fresh[1:-1] = kind[1:] != kind[:-1]
    fresh[offsets] = True
    edges = np.flatnonzero(fresh)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return (span_hash(prefix_hash(low), starts, ends) % np.uint64(BUCKETS)).astype(np.int64), ends - starts, np.searchsorted(starts, offsets)


def _squeezed(sums: np.ndarray) -> bytes:
    return zstandard.compress(planes(sums), 1)


def _stretched(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vectors of the buckets, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIMS, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch):
                bucket, _, first = words(data, offsets)
                if len(bucket) < 2:
                    continue
                joined = np.ones(len(bucket) - 1, bool)
                joined[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(bucket))] - 1] = False
                a, b = bucket[:-1][joined], bucket[1:][joined]
                for own, near in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        n = np.bincount(own * DIMS + PLACES[near, k], minlength=len(sums))
                        sums += n * int(SIGNS[0, k])
        group = TaskContext.get().partitionId() >> LEVELS[0]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array([_squeezed(p) for p in np.split(sums, PARTS)], pa.binary())], names=["part", "fan", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, fan, own in zip(batch.column("part").to_pylist(), batch.column("fan").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[part, fan] = sums.get((part, fan), 0) + _stretched(own)
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.int32()) for i in (0, 1)), pa.array([_squeezed(s) for s in sums.values()], pa.binary())], names=["part", "fan", "sums"])

    schema = "part int, fan int, sums binary"
    tasks = max(PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = docs.select("text").mapInArrow(count, schema)
    for bits in (*LEVELS[1:], 31):
        sums = sums.repartition(tasks, "part", "fan").mapInArrow(add, schema).withColumn("fan", F.shiftright("fan", bits))
    rows = sums.repartition(PARTS, "part").mapInArrow(add, schema).collect()
    out = np.zeros(BUCKETS * DIMS, np.float64)
    for r in rows:
        width = len(out) // PARTS
        out[r["part"] * width : (r["part"] + 1) * width] += _stretched(r["sums"])
    out = out.reshape(BUCKETS, DIMS)
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


class Features:
    """The features of documents under given context vectors."""

    def __init__(self, context: np.ndarray):
        index = np.zeros((BUCKETS, DIMS), np.float32)
        np.put_along_axis(index, PLACES, SIGNS.astype(np.float32), axis=1)
        self.vectors = np.concatenate([context, index / np.sqrt(NONZERO)], axis=1)

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(batch), WIDTH), np.float32)
        for row, end, data, offsets in blocks(batch, most=POOLED_BYTES):
            bucket, length, first = words(data, offsets)
            own = out[row:end]
            n = np.diff(first).astype(np.float64)
            many = np.maximum(1, n)
            owner = np.repeat(np.arange(len(n)), np.diff(first))
            at, step = 0, 1 << 17  # a long text's vectors are summed in pieces
            while at < len(bucket):
                some = slice(at, at + step)
                docs, heads = np.unique(owner[some], return_index=True)
                own[docs, : 2 * DIMS] += np.add.reduceat(self.vectors[bucket[some]], heads, axis=0)
                at += step
            own[:, : 2 * DIMS] /= many[:, None]
            bytes_ = np.diff(offsets).astype(np.float64)
            tally = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
            upper, signs = tally((data >= 65) & (data <= 90)), tally((data > 32) & ~WORD[LOWER[data]])
            lines = tally(data == 10)
            seen = np.zeros(len(n))
            if len(bucket):
                pairs = np.unique(owner * BUCKETS + bucket)
                seen = np.bincount(pairs // BUCKETS, minlength=len(n))
            total = np.bincount(owner, weights=length, minlength=len(n)) if len(bucket) else seen
            size = np.maximum(1, bytes_)
            plain = np.column_stack([np.log1p(bytes_) / 8, total / many / 8, np.minimum(1, seen / np.minimum(many, BUCKETS)), upper / size * 4, signs / size * 8, lines / size * 40, np.log1p(n) / 6, n > 0])
            own[:, 2 * DIMS :] = plain
        return out


@dataclass(frozen=True)
class Network:
    """Weights of the two layers, the features' centres and scales, and the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float
    share: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.centre) / self.scale) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -30, 30)))


def _loss(logit: np.ndarray, y: np.ndarray, temperature: float) -> float:
    z = logit / temperature
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the rest sets the temperature."""
    if len(set(y.tolist())) < 2:
        zero = np.zeros(WIDTH)
        return Network(zero, zero + 1, np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    check, train = order[: len(x) // 5], order[len(x) // 5 :]
    x, y = x.astype(np.float64), y.astype(np.float64)
    centre, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    weights = [random.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    means, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    z = (x - centre) / scale
    for _ in range(EPOCHS):
        for own in np.array_split(random.permutation(train), max(1, len(train) // BATCH)):
            hidden = np.tanh(z[own] @ weights[0] + weights[1])
            slope = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3][0]))) - y[own]) / len(own)
            back = slope[:, None] * weights[2][None, :] * (1 - hidden * hidden)
            grads = [z[own].T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ slope + DECAY * weights[2], np.array([slope.sum()])]
            step += 1
            for w, g, m, v in zip(weights, grads, means, squares, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    held = check if len(check) >= 10 else train
    logit = net.logit(x[held])
    best = min(np.geomspace(0.25, 8, 41), key=lambda t: _loss(logit, y[held], t))
    return Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3][0]), float(best))


def _features(docs: DataFrame, keep: list[str], shared) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in batches:
            found = features.of(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([f.tobytes() for f in found], pa.binary())], names=[*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(apply, docs.select(*keep).schema.add("features", "binary"))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> tuple[Network, np.ndarray]:
    """The network and the context vectors, from labels whose crc32 of the id does not leave ``remainder``."""
    context = context_vectors(docs)
    known = labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)").filter(F.crc32(F.col("labelled").cast("string")) % modulus != remainder)
    picked = known.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(LABELLED)
    # at most LABELLED ids: a bounded side
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).select("quality", "labelled", "text")
    found = _features(rows, ["quality", "labelled"], docs.sparkSession.sparkContext.broadcast(context)).orderBy(F.xxhash64("labelled"), "labelled", "quality", "features").limit(LABELLED).collect()
    x = np.array([np.frombuffer(r["features"], np.float32) for r in found]).reshape(-1, WIDTH)
    return fit(x, np.array([r["quality"] for r in found], np.int64)), context


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    network, context = train(docs, labels, modulus, remainder)
    shared = docs.sparkSession.sparkContext.broadcast((network, context))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, vectors = shared.value
        features = Features(vectors)
        for batch in batches:
            found = net.score(features.of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(modulus, remainder).alias("held_out"), "text")
    return rows.mapInArrow(apply, rows.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer"))
