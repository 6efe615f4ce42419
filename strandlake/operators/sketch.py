"""K-mer sketches and set-similarity routing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as Q
from strandlake.operators.selection import top_per_key
from strandlake.session import scratch_path, staged
from strandlake.sources.stores import opened

#: Rows of a query's postings that may be broadcast.
BROADCAST_ROWS = 1_000_000


def hash60(kmer: Column) -> Column:
    """60 bits of md5 as 15 hexadecimal digits: every engine has it, and its order is the string's."""
    return F.substring(F.md5(kmer), 1, 15)


def postings(rows: DataFrame, id_column: str, seq: str, k: int, keep_digits: str = "0123456789abcdef") -> DataFrame:
    """Distinct (id, h) of the k-mers whose hash begins with one of ``keep_digits`` (a FracMin sketch).

    K-mers are made distinct inside each row, so the sketch needs no shuffle where ids are unique.
    """
    exploded = rows.select(id_column, F.explode(F.array_distinct(Q.kmers(F.col(seq), k))).alias("_k")).select(id_column, hash60(F.col("_k")).alias("h"))
    if len(keep_digits) < 16:
        exploded = exploded.filter(F.substring("h", 1, 1).isin(*keep_digits))
    return exploded


def bottom(rows: DataFrame, id_column: str, n: int) -> DataFrame:
    """The n smallest distinct hashes of each id (bottom-n MinHash)."""
    return top_per_key(rows.select(id_column, "h").distinct(), [id_column], [F.col("h")], n)


def bottom_of(rows: DataFrame, key: str, seq: str, k: int, n: int, keep_digit: str = "") -> DataFrame:
    """(key, h): the n smallest hashes of all k-mers of each key's rows, if they begin with ``keep_digit``.

    Each row gives its own n smallest ones, so no more than that is exploded or shuffled.
    """
    hashes = F.transform(F.array_distinct(Q.kmers(F.col(seq), k)), hash60)
    if keep_digit:
        hashes = F.filter(hashes, lambda h: F.startswith(h, F.lit(keep_digit)))
    own = rows.select(key, F.explode(F.slice(F.array_sort(F.array_distinct(hashes)), 1, n)).alias("h"))
    return bottom(own, key, n)


def similarities(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(query, reference, shared, jaccard, containment) of all pairs that share a hash, via the inverted index.

    ``queries`` (query, h) is a stated query set. If its postings are few enough they are broadcast as lists by hash, and one pass over the references'
    postings counts both their sizes and what they share, so only partial counts are shuffled and nothing but them is written.
    """
    q = staged(queries, "queries")
    q_size = q.groupBy("query").agg(F.count("*").alias("_q"))
    if q.count() <= BROADCAST_ROWS:
        listed = F.broadcast(q.groupBy("h").agg(F.collect_list("query").alias("_queries")))
        nothing = F.array(F.lit(None).cast(q.schema["query"].dataType))
        # each posting counts once for its reference (no query), and once for each query that has its hash
        each = references.join(listed, "h", "left").select("reference", F.explode(F.concat(nothing, F.coalesce("_queries", F.array().cast(f"array<{q.schema['query'].dataType.simpleString()}>")))).alias("query"))
        counts = staged(each.groupBy("reference", "query").agg(F.count("*").alias("shared")), "shared")
        shared, r_size = counts.filter("query IS NOT NULL"), counts.filter("query IS NULL").select("reference", F.col("shared").alias("_r"))
    else:
        r = staged(references, "references")
        shared, r_size = r.join(q, "h").groupBy("query", "reference").agg(F.count("*").alias("shared")), r.groupBy("reference").agg(F.count("*").alias("_r"))
    sized = shared.join(q_size, "query").join(r_size, "reference")
    return sized.select("query", "reference", "shared", (F.col("shared") / (F.col("_q") + F.col("_r") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.col("_q")).alias("containment"))


#: Query postings of ``best_pairs`` that the driver collects and every worker holds, and pairs of a reference's and a query's common hashes that are counted at once.
INDEX_POSTINGS, PAIRS_AT_ONCE = 8_000_000, 4_000_000


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds doubles: halves of the shortest decimal go up."""
    scaled = x * 10**digits
    out = np.floor(scaled + 0.5) / 10**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def best_pairs(queries: DataFrame, references: DataFrame, k: int, measure: str = "jaccard", digits: int | None = None, part: str | None = None, last: bool = False, drop_self: bool = False) -> DataFrame:
    """``similarities`` without most pairs that can't be among the k best of a query by ``measure`` (rounded to ``digits``), or of a query and a ``part`` of the references.

    Which are the best is for a ranking to decide that follows; of equal ones it may take the smallest references, or the largest with ``last``. Measures: jaccard, containment, overlap (the larger).
    It is the references' postings that are shuffled, a number each: a reference meets all queries in one place, where common hashes are counted by the queries' inverted index. A pair that is no better than
    k earlier ones of its task is dropped there, so the pairs, whose number grows with the square of the rows, are neither shuffled nor written. Rows (query, h) and (reference, h) are distinct.
    """
    from strandlake.operators.selection import _scanned

    q = staged(queries, "queries")
    sizes = q.groupBy("query").agg(F.count("*").alias("_q"))
    own = q
    if q.count() > INDEX_POSTINGS:
        own = staged(q.join(references.select("h").distinct(), "h", "left_semi"), "known")
        if own.count() > INDEX_POSTINGS:
            near = similarities(queries, references.select("reference", "h")).withColumn("overlap", F.greatest("jaccard", "containment"))
            near = near.join(references.select("reference", part).distinct(), "reference") if part else near
            return near.filter("query != reference") if drop_self else near
    numbered = staged(own.select("h").distinct().withColumn("_h", F.monotonically_increasing_id()), "numbered")
    index = own.join(numbered, "h").join(sizes, "query").select("query", "_h", "_q").toArrow()
    encoded = index.column("query").combine_chunks().dictionary_encode()
    names, rows = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    q_n = np.zeros(len(names), np.int64)
    q_n[rows] = index.column("_q").to_numpy()
    hashes = index.column("_h").to_numpy()
    order = np.argsort(hashes, kind="stable")
    shared_index = q.sparkSession.sparkContext.broadcast((names, q_n, hashes[order], rows[order]))
    parts = [part] if part else []
    few = numbered.count() <= BROADCAST_ROWS
    met = references.join(F.broadcast(numbered) if few else numbered, "h", "left").select("reference", *parts, "_h")
    bar: dict = {}  # of each part, the scores of the k best so far of each query

    def better(scores: np.ndarray, qi: np.ndarray, key) -> np.ndarray:
        """The pairs, in order of their references, that are among the k best of their query so far."""
        if key not in bar:
            bar[key] = np.full((len(shared_index.value[0]), k), -1.0)
        best = bar[key]
        at = np.flatnonzero(scores >= best[qi, -1] if last else scores > best[qi, -1])
        at = at[np.lexsort((-at if last else at, -scores[at], qi[at]))]
        first = np.flatnonzero(np.append(True, qi[at][1:] != qi[at][:-1])) if len(at) else at
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        at, place = at[place < k], place[place < k]
        some, which = np.unique(qi[at], return_inverse=True)
        joined = np.full((len(some), 2 * k), -1.0)
        joined[:, :k] = best[some]
        joined[which, k + place] = scores[at]
        best[some] = -np.sort(-joined, axis=1)[:, :k]
        return at

    def work(table: pa.Table, cuts: np.ndarray):
        names, q_n, hashes, rows = shared_index.value
        number = table.column("_h").to_numpy(zero_copy_only=False)
        known = np.flatnonzero(~table.column("_h").is_null().to_numpy().astype(bool))
        found = number[known].astype(np.int64)
        low = np.searchsorted(hashes, found, "left")
        n = np.searchsorted(hashes, found, "right") - low
        reference, r_n = np.searchsorted(cuts, known, "right") - 1, np.diff(cuts)
        upto, begin, done = np.append(0, np.cumsum(n)), np.searchsorted(reference, np.arange(len(cuts))), 0
        while done < len(r_n):
            # whole references at a time, so that a pair is counted at once
            end = max(done + 1, int(np.searchsorted(upto[begin], upto[begin[done]] + PAIRS_AT_ONCE, "right")) - 1)
            a, b = begin[done], begin[end]
            places = np.repeat(low[a:b] - (upto[a:b] - upto[a]), n[a:b]) + np.arange(upto[b] - upto[a])
            pairs, shared = np.unique(np.repeat(reference[a:b], n[a:b]) * len(names) + rows[places], return_counts=True)
            done = end
            ri, qi = pairs // max(1, len(names)), pairs % max(1, len(names))
            at = cuts[ri]
            if drop_self:
                other = pc.not_equal(names.take(pa.array(qi)), table.column("reference").take(pa.array(at)).combine_chunks()).to_numpy(zero_copy_only=False).astype(bool)
                ri, qi, at, shared = ri[other], qi[other], at[other], shared[other]
            score = {"jaccard": shared / (q_n[qi] + r_n[ri] - shared), "containment": shared / q_n[qi]}
            score["overlap"] = np.maximum(score["jaccard"], score["containment"])
            value = _rounded(score[measure], digits) if digits else score[measure]
            if part:
                coded = pc.dictionary_encode(table.column(part).take(pa.array(at)).combine_chunks(), null_encoding="encode")
                codes = coded.indices.to_numpy(zero_copy_only=False)
                groups = [(v, np.flatnonzero(codes == i)) for i, v in enumerate(coded.dictionary.to_pylist())]
            else:
                groups = [(None, np.arange(len(qi)))]
            for key, some in groups:
                x = some[better(value[some], qi[some], key)]
                columns = {"query": names.take(pa.array(qi[x])), "reference": table.column("reference").take(pa.array(at[x]))} | {c: table.column(c).take(pa.array(at[x])) for c in parts}
                yield pa.table(columns | {"shared": pa.array(shared[x], pa.int64())} | {c: pa.array(v[x], pa.float64()) for c, v in score.items()})

    kinds = {"query": queries.schema["query"], "reference": references.schema["reference"]} | {c: references.schema[c] for c in parts}
    fields = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in kinds.items()) + ", shared bigint, jaccard double, containment double, overlap double"
    return _scanned(met, ["reference"], [], fields, work)


def route_topk(queries: DataFrame, references: DataFrame, k: int = 4, drop_self: bool = True) -> DataFrame:
    """The k nearest references of each query by Jaccard; ties go to the smaller reference."""
    near = best_pairs(queries, references, k, "jaccard", 6, drop_self=drop_self).withColumn("jaccard", F.round("jaccard", 6))
    return top_per_key(near, ["query"], [F.col("jaccard").desc(), F.col("reference")], k, "rank").select("query", "reference", "shared", "jaccard", "rank")


def jaccard_distance(a: Column, b: Column) -> Column:
    """Jaccard distance of two arrays of distinct values: 0 if both are empty, 1 if one is."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(1 - shared / (F.size(a) + F.size(b) - shared))


def shared_anchor_pairs(rows: DataFrame, id_column: str, least: int = 2, degree: int | None = 48) -> DataFrame:
    """Pairs of reads with at least ``least`` common minimizers; a minimizer of over ``degree`` reads links only neighbours (None: all links).

    Where a minimizer is common, its reads are chained in the order of their ids instead of paired all with all; that
    keeps the number of pairs linear, but loses pairs whose common minimizers are all of that kind.
    """
    if degree is None:
        each = rows.select(id_column, "h").distinct()
        both = each.select("h", F.col(id_column).alias("a")).join(each.select("h", F.col(id_column).alias("b")), "h").filter("a < b")
        return both.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    order = Window.partitionBy("h").orderBy(id_column)
    counted = rows.select(id_column, "h").distinct().withColumn("_n", F.count("*").over(Window.partitionBy("h")))
    few = counted.filter(F.col("_n") <= degree).select("h", F.col(id_column).alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), "h").filter("a < b").select("a", "b")
    chained = counted.filter(F.col("_n") > degree).withColumn("b", F.lead(id_column).over(order)).filter("b IS NOT NULL").select(F.col(id_column).alias("a"), "b")
    return pairs.union(chained).groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def anchor_classes(rows: DataFrame, id_column: str) -> DataFrame:
    """(id, representative, anchors): rows of reads' anchors (id, h) brought to one row a read; reads with the same anchors have the smallest of them as representative."""
    sets = rows.select(F.col(id_column).alias("_id"), "h").groupBy("_id").agg(F.array_sort(F.collect_set("h")).alias("anchors"))
    own = staged(sets.withColumn("_key", F.md5(F.concat_ws(",", F.col("anchors").cast("array<string>")))), "anchors")
    first = own.groupBy("_key").agg(F.min("_id").alias("representative"))
    return own.join(first, "_key").select(F.col("_id").alias(id_column), "representative", "anchors")


#: Postings and common anchors of one cell of pairs at most, as far as they are evenly spread, and common anchors that are counted at once.
CELL_POSTINGS, CELL_COMMON, COUNTED = 3_000_000, 20_000_000, 500_000
#: Tasks that count cells at most; beyond, a task has several.
CELL_TASKS = 10_000


@lru_cache(maxsize=2)
def _block(path: str, block: int, size: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of sets in the shared folder: ids, members, and for each posting its anchor and its row. Any number of sets but ``size`` is an error."""
    store, at = opened(path)
    table = pq.read_table(f"{at}/block={block}", filesystem=store, partitioning=None)
    if len(table) != size:
        raise RuntimeError(f"{path} has {len(table)} sets of block {block} in place of {size}")
    lists = table.column("_anchors").combine_chunks()
    return table.column("_id").combine_chunks(), table.column("_members").to_numpy(), pc.list_flatten(lists).to_numpy(), np.repeat(np.arange(size), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def exact_anchor_pairs(classes: DataFrame, id_column: str, least: int = 2, members: bool = False) -> DataFrame:
    """(a, b, shared): the representatives of ``anchor_classes`` with at least ``least`` common anchors; none is lost, however common an anchor is. Copies are not paired: they share all their anchors.

    Representatives are dealt into blocks, written once, and any two blocks meet in one cell, where common anchors are counted: a task reads its cells' blocks, so neither pairs nor sets are
    shuffled for it, and what is written before the result grows with the sets. Anchors of one set only are left out first, and so are sets with fewer than ``least`` others. The common anchors of all
    pairs are work that no exact count can save: it grows with the square of an anchor's sets, as does what is read. ``members`` adds ``a_members`` and ``b_members``, how many reads each stands for.
    """
    spark, kind = classes.sparkSession, classes.schema[id_column].dataType.simpleString()
    sizes = classes.groupBy("representative").agg(F.count("*").alias("_members"))
    first = classes.filter(F.col(id_column) == F.col("representative")).filter(F.size("anchors") >= least).select("representative", F.explode("anchors").alias("h"))
    sets = staged(first, "sets")
    counted = staged(sets.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1"), "counted")
    postings_, common = counted.agg(F.sum("_n"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2)).first()
    # any two anchors have numbers of their own: 32 bits at least, by their places in the partitions
    numbered = counted.select("h", F.monotonically_increasing_id().alias("_h"))
    listed = sets.join(numbered, "h").groupBy("representative").agg(F.collect_list("_h").alias("_anchors")).filter(F.size("_anchors") >= least)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = min((6 * parts) ** 0.5, ((common or 0) / 1_000_000) ** 0.5)
    blocks = max(1, math.ceil(max((postings_ or 0) / CELL_POSTINGS, ((common or 0) / CELL_COMMON) ** 0.5, spread)))
    own = F.pmod(F.xxhash64("representative"), blocks).cast("int")
    rows = listed.join(sizes, "representative").select(own.alias("block"), F.col("representative").alias("_id"), "_members", "_anchors")
    path = scratch_path(spark, "blocks")
    rows.repartition(blocks, "block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).groupBy("block").agg(F.count("*").alias("_n")).orderBy("block").collect()
    dealt = [(r["block"], r["_n"]) for r in found]
    i_of, j_of = np.triu_indices(len(dealt))

    def cell(i: int, j: int) -> Iterator[pa.Table]:
        left, right = _block(path, *dealt[i]), _block(path, *dealt[j])
        order = np.argsort(right[2], kind="stable")
        keys, rows_, width = right[2][order], right[3][order], max(1, len(right[0]))
        low = np.searchsorted(keys, left[2], "left")
        found = np.searchsorted(keys, left[2], "right") - low
        # whole rows of the left side at a time, so that a pair is counted at once
        ends = np.flatnonzero(np.diff(left[3], append=-1)) + 1
        upto, row, done = np.cumsum(found)[ends - 1], 0, 0
        while row < len(ends):
            last = max(row + 1, int(np.searchsorted(upto, done + COUNTED, "right")))
            at, end = int(ends[row - 1]) if row else 0, int(ends[last - 1])
            row, done = last, int(upto[last - 1])
            n = found[at:end]
            places = np.repeat(low[at:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs = np.repeat(left[3][at:end], n) * width + rows_[places]
            if i == j:
                pairs = pairs[pairs // width < pairs % width]
            pairs, shared = np.unique(pairs, return_counts=True)
            pairs, shared = pairs[shared >= least], shared[shared >= least]
            x, y = pairs // width, pairs % width
            a, b, an, bn = left[0].take(pa.array(x)), right[0].take(pa.array(y)), left[1][x], right[1][y]
            swap = pc.greater(a, b)
            turned = swap.to_numpy(zero_copy_only=False).astype(bool)
            yield pa.table({"a": pc.if_else(swap, b, a), "b": pc.if_else(swap, a, b), "shared": pa.array(shared, pa.int64()), "a_members": pa.array(np.where(turned, bn, an), pa.int64()), "b_members": pa.array(np.where(turned, an, bn), pa.int64())})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                for table in cell(int(i_of[n]), int(j_of[n])):
                    yield from table.to_batches()

    cells = spark.range(0, len(i_of), 1, max(1, min(len(i_of), CELL_TASKS)))
    out = cells.mapInArrow(apply, f"a {kind}, b {kind}, shared bigint, a_members bigint, b_members bigint")
    return out if members else out.select("a", "b", "shared")
