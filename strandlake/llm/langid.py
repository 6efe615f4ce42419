"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of every labelled document in Spark; the log-probability matrix
(languages x buckets, of fixed width) is broadcast, and batches are scored sparsely in numpy.

A batch of texts is one sparse matrix of counts (text, bucket), which is multiplied with the rows of the matrix that it uses.
Texts are lower-cased, runs of characters other than letters become one blank, and n-grams of one to three
characters are hashed into ``BUCKETS`` counters. The prediction and its score, the posterior, take all n-grams of a text
at full weight. A text that is null or has no letter gets ``und`` and 0.0.
Without any labelled row every text gets ``und``. Repeated rows are scored one by one; a null doc_id is kept,
and its row is never learnt from. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.text import released

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Parts of the buckets' range, and the bits of a task's number that each of the levels of partial sums drops: at a million tasks none adds up more than 256 tables.
SLICES, LEVELS = 8, (6, 6)
ORDERS = 3
#: Characters handled at once, so that a very long text needs little memory.
CHUNK = 1 << 18
#: Products of counts and log-probabilities held at once.
CELLS = 1 << 20
#: Most languages a model may have, more being an error: the matrix (32-bit) is then 128 MB at most.
MOST_LANGUAGES = 1024
NAMES = ["lang", "slice", "part", "docs", "counts"]

_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _table[0]


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, in pieces; nothing if it has no letter."""
    letters, tail = _letters(), np.array([32], np.uint32)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters[points]
        if not known.any() and len(text) <= CHUNK:
            return
        x = np.concatenate([tail, np.where(known, points, np.uint32(32)), np.array([32], np.uint32)] if at + CHUNK >= len(text) else [tail, np.where(known, points, np.uint32(32))])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = x[keep].astype(np.uint64)
        old = len(tail) if at else 1
        tail = x[-(ORDERS - 1) :].astype(np.uint32)
        out, h = [], np.zeros(len(x), np.uint64)
        for order in range(1, ORDERS + 1):
            h = (h[:-1] if order > 1 else h) * np.uint64(0x100000001B3) + (x[order - 1 :] + np.uint64(order << 24))
            fresh = h[max(0, old - order + 1) :] if at else h
            out.append(((fresh * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        yield np.concatenate(out)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse counts of a batch, sorted: text, bucket, count. Texts without a letter have none."""
    out: list[np.ndarray] = []
    row = 0
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and (end == row or size + len(texts[end]) < CHUNK):
            size += len(texts[end])
            end += 1
        if size >= CHUNK:  # a long text is a matrix row of its own, in pieces
            sums = np.zeros(BUCKETS, np.int64)
            for found in buckets(texts[row]):
                sums += np.bincount(found, minlength=BUCKETS)
            used = np.flatnonzero(sums) if any(_has_letter(texts[row][at : at + CHUNK]) for at in range(0, len(texts[row]), CHUNK)) else np.zeros(0, np.int64)
            out.append(np.stack([np.full(len(used), row), used, sums[used]]))
        else:
            out.append(_counted_together(texts[row:end], row))
        row = end
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return found[0], found[1], found[2]


def _has_letter(text: str) -> bool:
    return bool(_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def _counted_together(texts: list[str], base: int) -> np.ndarray:
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(f" {t} \n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 3 for t in low]) - 1
    known = _letters()[points]
    x = np.where(known, points, np.uint32(32))
    x[ends] = 10
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = x[keep].astype(np.uint64)
    edge = x == 10
    owner = np.cumsum(edge) - edge
    lettered = np.zeros(len(texts), bool)
    lettered[owner[(x != 32) & ~edge]] = True
    bad, h, parts = edge, np.zeros(len(x), np.uint64), []
    for order in range(1, ORDERS + 1):
        if order > 1:
            h, bad = h[:-1], bad[:-1] | edge[order - 1 :]
        h = h * np.uint64(0x100000001B3) + (x[order - 1 :] + np.uint64(order << 24))
        own = ~bad & lettered[owner[: len(h)]] if len(texts) else ~bad
        bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        parts.append((owner[: len(h)][own] << BUCKET_BITS) | bucket[own])
    keys, n = np.unique(np.concatenate(parts), return_counts=True)
    return np.stack([(keys >> BUCKET_BITS) + base, keys & (BUCKETS - 1), n])


@dataclass(frozen=True)
class Model:
    """Log-probabilities of the buckets (one row each) under each language, and the languages' log priors."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The most likely language of each text and its posterior."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        owner, bucket, count = counted([t or "" for t in texts])
        if not len(owner):
            return out
        rows, first = np.unique(owner, return_index=True)
        ends = np.append(first[1:], len(owner))
        score, at = np.empty((len(rows), len(self.languages))), 0
        while at < len(rows):
            most = first[at] + max(1, CELLS // len(self.languages))
            end = max(at + 1, int(np.searchsorted(ends, most, side="right")))
            some = slice(first[at], ends[end - 1])
            score[at:end] = np.add.reduceat(count[some, None] * self.log_prob[bucket[some]].astype(np.float64), first[at:end] - first[at], axis=0)
            at = end
        score += self.log_prior
        best = score.argmax(axis=1)
        chance = 1.0 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        for row, k, p in zip(rows.tolist(), best.tolist(), chance.tolist(), strict=True):
            out[row] = (self.languages[k], p)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.3) -> Model:
    """Learns from all rows of ``labelled`` that have a language; what reaches the driver has a fixed width per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 1024):
                names = np.array(batch.column(1).slice(at, 1024).to_pylist(), object)
                owner, bucket, n = counted([t or "" for t in batch.column(0).slice(at, 1024).to_pylist()])
                for name in set(names.tolist()):
                    own = np.flatnonzero(names == name)
                    docs[name] = docs.get(name, 0) + len(own)
                    mine = np.isin(owner, own)
                    if name not in sums:
                        sums[name] = np.zeros(BUCKETS, np.int64)
                    sums[name] += np.bincount(bucket[mine], weights=n[mine], minlength=BUCKETS).astype(np.int64)
        group = TaskContext.get().partitionId() >> LEVELS[0]
        for name, own in sums.items():
            parts = np.split(own, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array([name] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array([group] * SLICES, pa.int32()), pa.array([docs[name]] * SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = sums.setdefault((row["lang"], row["slice"], row["part"]), [0, np.zeros(BUCKETS // SLICES, np.int64)])
                own[0] += row["docs"]
                own[1] += np.frombuffer(row["counts"], np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array([k[2] for k in sums], pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=NAMES)

    schema = "lang string, slice int, part int, docs long, counts binary"
    known = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang IS NOT NULL")
    tasks = max(SLICES, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = known.mapInArrow(lambda batches: released(count(batches)), schema)
    for bits in (*LEVELS[1:], 31):
        sums = sums.repartition(tasks, "lang", "slice", "part").mapInArrow(add, schema).withColumn("part", F.shiftright("part", bits))
    sums = sums.repartition(SLICES, "lang", "slice").mapInArrow(add, schema)
    rows = sums.limit(SLICES * MOST_LANGUAGES + 1).collect()
    if len(rows) > SLICES * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = tuple(sorted({r["lang"] for r in rows}))
    if not languages:
        return Model((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    counts, docs = np.zeros((len(languages), BUCKETS)), np.zeros(len(languages))
    for r in rows:
        k, width = languages.index(r["lang"]), BUCKETS // SLICES
        docs[k] = r["docs"]
        counts[k, r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    counts += alpha
    log_prob = np.log(counts / counts.sum(axis=1, keepdims=True))
    return Model(languages, np.log(docs / docs.sum()), np.ascontiguousarray(log_prob.T.astype(np.float32)))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with the predicted language and its probability added under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, *([] if text in keep else [text]))
    schema = rows.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, len(whole), 1024)):
            found = own.predict_all(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, *names])

    return rows.mapInArrow(lambda batches: released(apply(batches)), schema)


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from those not held out."""
    model = fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % modulus != remainder))
    rows = docs.select("doc_id", held_out(modulus, remainder).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Drops the documents without a language: no letter, or no language of at least ``least``."""
    columns = docs.columns
    model = fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    scored = predict(docs, model, columns, names=("strandlake_lang", "strandlake_score"))
    return scored.filter((F.col("strandlake_lang") != "und") & (F.col("strandlake_score") >= least)).select(*columns)
