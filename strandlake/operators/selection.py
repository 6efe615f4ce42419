"""Rankings, quotas, de-duplication and greedy selections of calls."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in a total order. Spark pushes such a rank limit below the shuffle."""
    out = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def quota_then_rank(rows: DataFrame, kind: str, order: list[Column], top: int) -> DataFrame:
    """A diverse top list: first up to a quota of each kind, then the best of the rest, then sorted again.

    The quota is max(3, min(25, top // (2 * kinds))). Only ``top`` rows of each kind can get in, so ranks are cut before any global order.
    """
    kinds = max(1, rows.select(kind).distinct().count())
    quota = max(3, min(25, top // (2 * kinds)))
    best = top_per_key(rows, [kind], order, top, "_own")
    first = F.when(F.col("_own") <= quota, 0).otherwise(1)
    return best.withColumn("_late", first).orderBy("_late", *order).limit(top).drop("_own", "_late")


def reserved_then_rank(rows: DataFrame, keys: list[str], part: str, order: list[Column], reserved: int = 3, cap: int = 256) -> DataFrame:
    """Per key: up to ``reserved`` rows of each part first, the best of the rest up to ``cap``."""
    ranked = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)))
    late = F.when(F.col("_own") <= reserved, 0).otherwise(1)
    return top_per_key(ranked.withColumn("_late", late), keys, [F.col("_late"), *order], cap).drop("_own", "_late")


def collapse(rows: DataFrame, keys: list[str], best: Column) -> DataFrame:
    """The row of each key with the largest ``best`` (a total order), by a max_by that combines on the map side."""
    columns = [c for c in rows.columns]
    packed = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*columns), best).alias("_row"))
    return packed.select("_row.*")


def run_merge(rows: DataFrame, keys: list[str], start: str, length: str, gap: int = 80, width: int | None = None) -> DataFrame:
    """Adjacent events of a key within ``gap`` become one: first start, last end, longest length, count."""
    from strandlake.operators.intervals import in_one_range, islands

    ended = rows.select(*keys, start, length, (F.col(start) + F.col(length)).alias("_end"))
    marked = islands(ended, keys, start, "_end", gap, [F.col(start), F.col(length).desc()], width, in_one_range(rows, start, width))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max("_end").alias("end"), F.max(length).alias(length), F.count("*").alias("n")).drop("_island")


def _scanned(rows: DataFrame, keys: list[str], order: list[Column], schema, work, placed: bool = False) -> DataFrame:
    """Streams sorted groups through ``work``: one shuffle by key (none if the rows are ``placed`` by some of the keys), a sort, and one task that passes over its groups in turn.

    ``work(table)`` gets an Arrow table of some whole groups with their edges (row numbers, n+1) and returns an Arrow table, or some one after another. Only
    one group has to fit in memory; small ones come many at once.
    """

    def changes(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
        """The rows of a batch whose key is another than that of the row before."""
        new = np.zeros(len(batch), bool)
        for k in keys:
            column = batch.column(k)
            null = column.is_null().to_numpy(zero_copy_only=False)
            differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False).astype(bool)
            new[1:] |= differ & ~(null[1:] & null[:-1])
            new[0] |= before is None or before.column(k)[-1].as_py() != column[0].as_py()
        return np.flatnonzero(new)

    def made(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = work(table, cuts)
        for part in [out] if isinstance(out, pa.Table) else out:
            yield from part.to_batches()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the group that is open
        for batch in batches:
            if not len(batch):
                continue
            first = changes(batch, held[-1] if held else None)
            if len(first) and held:
                open_ = pa.Table.from_batches([*held, batch.slice(0, first[0])])
                yield from made(open_, np.array([0, len(open_)]))
                held = []
            if len(first):
                if len(first) > 1:
                    whole = pa.Table.from_batches([batch.slice(first[0], first[-1] - first[0])])
                    yield from made(whole, first - first[0])
                batch = batch.slice(first[-1])
            held.append(batch)
        if held:
            open_ = pa.Table.from_batches(held)
            yield from made(open_, np.array([0, len(open_)]))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows if placed else rows.repartition(parts, *keys)).sortWithinPartitions(*keys, *order).mapInArrow(apply, schema)


class Chosen:
    """Intervals that do not meet, by their starts, in runs of bounded length: a look-up is two bisections, an insertion moves one run."""

    MOST = 512

    def __init__(self) -> None:
        self.heads: list[float] = []
        self.runs: list[list[tuple[int, int]]] = []

    def around(self, start: int) -> tuple[tuple[float, float], tuple[float, float]]:
        """The last interval that begins before ``start``, and the first that does not."""
        none_before, none_after = (-math.inf, -math.inf), (math.inf, math.inf)
        r = bisect.bisect_left(self.heads, start) - 1
        if r < 0:
            return none_before, self.runs[0][0] if self.runs else none_after
        run = self.runs[r]
        at = bisect.bisect_left(run, (start,))
        after = run[at] if at < len(run) else self.runs[r + 1][0] if r + 1 < len(self.runs) else none_after
        return run[at - 1], after

    def add(self, start: int, end: int) -> None:
        r = max(0, bisect.bisect_left(self.heads, start) - 1)
        if not self.runs:
            self.heads, self.runs = [start], [[(start, end)]]
            return
        run = self.runs[r]
        bisect.insort(run, (start, end))
        self.heads[r] = run[0][0]
        if len(run) > self.MOST:
            half = len(run) // 2
            self.runs[r : r + 1] = [run[:half], run[half:]]
            self.heads[r : r + 1] = [run[0][0], run[half][0]]


def non_overlapping(rows: DataFrame, keys: list[str], start: str, end: str, score: str, slop: int = 20, width: int | None = None) -> DataFrame:
    """Greedy choice by falling score of intervals that keep ``slop`` from all chosen ones of their key.

    Ties go to the earlier, then the shorter interval. Intervals that are further apart than ``slop`` do not touch each other's choice, so a contig is cut at
    such gaps, and a task scans runs between them.
    """
    from strandlake.operators.intervals import in_one_range, islands

    whole, keys, tasks = rows.columns, [*keys, "_island"], in_one_range(rows, start, width)
    rows = islands(rows, keys[:-1], start, end, slop, width=width, tasks=tasks)
    rest = [c for c in rows.columns if c not in (score, start, end, *keys)]

    def work(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        s, e, keep = table.column(start).to_pylist(), table.column(end).to_pylist(), np.zeros(len(table), bool)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            chosen = Chosen()
            for i in range(low, high):
                (_, end_before), (next_start, _) = chosen.around(s[i])
                if end_before + slop < s[i] and e[i] + slop < next_start:
                    chosen.add(s[i], e[i])
                    keep[i] = True
        return table.filter(pa.array(keep))

    return _scanned(rows, keys, [F.col(score).desc(), F.col(start), F.col(end), *map(F.col, rest)], rows.schema, work, tasks > 0).select(*whole)


def greedy_clusters(rows: DataFrame, keys: list[str], position: str, tolerance: int, width: int | None = None) -> DataFrame:
    """Single pass in order of position: a row joins the open cluster if its first member lies within ``tolerance``.

    Islands would chain distances; here it is the distance to a cluster's first row, so a scan is needed. A gap beyond the tolerance begins a cluster anyway, so
    runs between gaps are scanned apart, and numbered on from the clusters before them.
    """
    from strandlake.operators.intervals import in_one_range, islands, running

    whole, keys, tasks = rows.columns, [*keys, "_island"], in_one_range(rows, position, width)
    rows = islands(rows, keys[:-1], position, position, tolerance, width=width, tasks=tasks)
    rest = [c for c in rows.columns if c not in (position, *keys)]

    def work(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        places, out = table.column(position).to_pylist(), []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            head, number = None, -1
            for i in range(low, high):
                if head is None or places[i] - head > tolerance:
                    head, number = places[i], number + 1
                out.append(number)
        return table.append_column("cluster", pa.array(out, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cluster bigint"
    found = _scanned(rows, keys, [F.col(position), *map(F.col, rest)], fields, work, tasks > 0)
    sizes = found.groupBy(*keys).agg((F.max("cluster") + 1).alias("_n"))
    before = running(sizes, keys[:-1], "_island", [F.col("_island")], F.col("_n"), "_before", "sum", False, width=width).drop("_n")
    named = {k: f"_c{i}" for i, k in enumerate(keys)}
    before = before.select(*[F.col(k).alias(n) for k, n in named.items()], "_before")
    joined = found.join(before, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    return joined.select(*whole, (F.col("cluster") + F.coalesce("_before", F.lit(0))).alias("cluster"))


def greedy_match(truth: DataFrame, calls: DataFrame, keys: list[str], tolerance: int, length_share: float, width: int | None = None) -> DataFrame:
    """One-to-one matches of calls to truth, nearest first.

    Both sides have ``keys``, id, pos, len. Pairs within the tolerances are sorted by (distance, truth id, call id), and one is taken if both
    ends are free. Candidate pairs are searched in sorted positions, never all against all; a contig is cut where neighbours are further apart than the tolerance.
    Returns keys, truth_id, call_id, distance.
    """
    from strandlake.operators.intervals import in_one_range, islands
    from strandlake.session import staged

    both = truth.select(*keys, F.lit(0).alias("side"), "id", "pos", "len").union(calls.select(*keys, F.lit(1).alias("side"), "id", "pos", "len"))
    both = staged(both, "both")  # read for its range and for its rows
    tasks = in_one_range(both, "pos", width)
    both = islands(both, keys, "pos", "pos", tolerance, width=width, tasks=tasks)
    scanned = [*keys, "_island"]

    def work(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        side, ids, pos, size = (table.column(c).to_numpy() for c in ("side", "id", "pos", "len"))
        rows, t_out, c_out, d_out = [], [], [], []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            middle = low + int(np.searchsorted(side[low:high], 1))
            if middle in (low, high):
                continue
            first = middle + np.searchsorted(pos[middle:high], pos[low:middle] - tolerance)
            n = middle + np.searchsorted(pos[middle:high], pos[low:middle] + tolerance, side="right") - first
            ti = np.repeat(np.arange(low, middle), n)
            ci = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            near = np.abs(size[ti] - size[ci]) <= length_share * np.maximum(1, size[ti])
            ti, ci = ti[near], ci[near]
            d = np.abs(pos[ti] - pos[ci]) + np.abs(size[ti] - size[ci])
            used: set[int] = set()
            for j in np.lexsort((ids[ci], ids[ti], d)).tolist():
                a, b = int(ti[j]), int(ci[j])
                if a not in used and b not in used:
                    used |= {a, b}
                    rows.append(a)
                    t_out.append(int(ids[a]))
                    c_out.append(int(ids[b]))
                    d_out.append(int(d[j]))
        kept = table.select(keys).take(pa.array(rows, pa.int64()))
        return kept.append_column("truth_id", pa.array(t_out, pa.int64())).append_column("call_id", pa.array(c_out, pa.int64())).append_column("distance", pa.array(d_out, pa.int64()))

    fields = ", ".join(f"`{k}` {truth.schema[k].dataType.simpleString()}" for k in keys)
    return _scanned(both, scanned, [F.col("side"), F.col("pos"), F.col("id")], f"{fields}, truth_id bigint, call_id bigint, distance bigint", work, tasks > 0)


def represented(rows: DataFrame, keys: list[str], key: str, places: list[str], order: list[str | Column], tolerance: int) -> DataFrame:
    """(key, representative): rows taken in order; one becomes a representative unless an earlier one lies within ``tolerance`` in every place, and that is then the first such.

    Places are cut into cells one longer than the tolerance, so that rows of a cell always represent each other and each cell has one representative at most. In
    each round the first open row of a cell is kept if no earlier open one around it is near, and all rows near to it close. A row meets one row of each cell around its
    own, so no round makes pairs of all rows, however many share a place; a cell that has most rows is split by Spark as a skewed join. ``order`` with ``key`` must be total. Rows
    without a place are their own.
    """
    from strandlake.session import staged

    cells = [f"_c{i}" for i in range(len(places))]
    at = [F.floor(F.col(p) / (tolerance + 1)).cast("long").alias(c) for p, c in zip(places, cells, strict=True)]
    whole = staged(rows.select(F.col(key).alias("_id"), *keys, *[F.col(p).cast("long").alias(f"_p{i}") for i, p in enumerate(places)], *at, F.struct(*order, F.col(key)).alias("_o")), "places")
    missing = F.lit(False)
    for i in range(len(places)):
        missing = missing | F.col(f"_p{i}").isNull()
    open_ = whole.filter(~missing)
    points = [f"_p{i}" for i in range(len(places))]

    def around(some: DataFrame) -> DataFrame:
        """Each of ``some`` (of one row a cell) at its own cell and those beside it, under the names of who asks."""
        out = some.select(*keys, *cells, *[F.col(c).alias(f"_r{c}") for c in ("_id", "_o", *points)])
        for c in cells:
            out = out.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
        return out

    def near(some: DataFrame, others: DataFrame) -> DataFrame:
        met = others.join(around(some), [*keys, *cells])
        for p in points:
            met = met.filter(F.abs(F.col(p) - F.col(f"_r{p}")) <= tolerance)
        return met

    kept = None
    while open_.limit(1).count():
        first = staged(open_.groupBy(*keys, *cells).agg(F.min_by(F.struct("_id", "_o", *points), "_o").alias("_f")).select(*keys, *cells, "_f.*"), "first")
        blocked = near(first, open_).filter(F.col("_o") < F.col("_r_o")).select(F.col("_r_id").alias("_id")).distinct()
        now = staged(first.join(blocked, "_id", "left_anti"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        open_ = staged(open_.join(near(now, open_).select("_id").distinct(), "_id", "left_anti"), "open")
    alone = whole.filter(missing).select("_id", F.col("_id").alias("representative"))
    if kept is None:
        return alone.select(F.col("_id").alias(key), "representative")
    found = near(kept, whole.filter(~missing)).filter(F.col("_r_o") <= F.col("_o")).groupBy("_id").agg(F.min_by("_r_id", "_r_o").alias("representative"))
    return found.union(alone).select(F.col("_id").alias(key), "representative")


def without_shadows(calls: DataFrame, key: str, tolerance: int = 10_000) -> DataFrame:
    """Calls without the inversions and translocations that a better call of the same event shadows: of each cluster the best one stays.

    Inversions of a query and contig meet by their midpoints; translocations of a query and two contigs by both ends, whichever end is called the mate. Better is a higher block score,
    then a longer event. Calls of other types, and translocations without a mate, all stay. calls: query_asm, contig, svtype, pos, end, svlen, block_score, mate_contig, mate_pos.
    """
    order = [-F.coalesce("block_score", F.lit(0.0)), -F.abs(F.coalesce("svlen", F.lit(0)))]
    order = [o.alias(n) for o, n in zip(order, ("_score", "_size"), strict=True)]
    mated = F.coalesce(F.col("svtype").startswith("TRA") | (F.col("svtype") == "BND"), F.lit(False)) & F.coalesce(F.col("mate_contig") != ".", F.lit(False)) & F.col("contig").isNotNull()
    turned = F.struct("mate_contig", "mate_pos") < F.struct("contig", "pos")
    low, high = (F.when(turned, F.col(a)).otherwise(F.col(b)) for a, b in (("mate_contig", "contig"), ("contig", "mate_contig")))
    one, two = (F.when(turned, F.col(a)).otherwise(F.col(b)) for a, b in (("mate_pos", "pos"), ("pos", "mate_pos")))
    known = F.coalesce(F.col("mate_pos") != 0, F.lit(False))
    inverted = calls.filter("svtype = 'INV' AND query_asm IS NOT NULL AND contig IS NOT NULL").select(F.col(key).alias("_key"), "query_asm", "contig", F.floor((F.col("pos") + F.greatest("pos", F.coalesce("end", "pos"))) / 2).alias("_m"), "block_score", "svlen")
    moved = calls.filter(mated).filter("query_asm IS NOT NULL").select(F.col(key).alias("_key"), "query_asm", low.alias("_a"), high.alias("_b"), F.when(known, one).alias("_x"), F.when(known, two).alias("_y"), "block_score", "svlen")
    clusters = represented(inverted, ["query_asm", "contig"], "_key", ["_m"], order, tolerance).union(represented(moved, ["query_asm", "_a", "_b"], "_key", ["_x", "_y"], order, tolerance))
    shadows = clusters.filter(F.col("_key") != F.col("representative")).select(F.col("_key").alias(key))
    return calls.join(shadows, key, "left_anti")
