"""Joins and merges of integer intervals; all by equi-joins on bins, so that they partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = 1000, slack: int = 0, how: str = "inner") -> DataFrame:
    """Pairs with equal ``key`` whose closed intervals come within ``slack``.

    Both sides go to all bins they touch; a pair is kept only in the first bin that both share, so no distinct
    is needed. ``left_semi`` keeps left rows with a partner. Column names of the two sides must differ, but for ``key``.
    """
    ls, le, rs, re_ = *left_span, *right_span
    a = left.withColumn("_bin", F.explode(_bins(F.col(ls) - slack, F.col(le) + slack, width)))
    b = right.withColumnRenamed(key, "_key").withColumn("_bin2", F.explode(_bins(F.col(rs), F.col(re_), width)))
    near = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_bin2")) & (F.col(rs) <= F.col(le) + slack) & (F.col(re_) >= F.col(ls) - slack)
    if how == "left_semi":
        return a.join(b.select("_key", "_bin2", rs, re_), near, "left_semi").drop("_bin").dropDuplicates()
    first = F.greatest(F.floor((F.col(ls) - slack) / width), F.floor(F.col(rs) / width))
    return a.join(b, near & (F.col("_bin") == first), "inner").drop("_bin", "_bin2", "_key")


#: Positions of a range that one task scans; a longer contig is scanned in several.
RANGE = 1_000_000


def running(rows: DataFrame, keys: list[str], at: str, order: list, value: Column, name: str, how: str = "max", inclusive: bool = True, backward: bool = False, width: int | None = None) -> DataFrame:
    """Adds a running ``max``, ``min`` or ``sum`` of each key along its positions, without bringing a key into one task.

    Each range of ``width`` positions is scanned by itself; one row a range carries what lies before it (behind it, if ``backward``). ``order`` begins with ``at``, and
    has plain columns if ``backward``: that is a scan from the end, since a frame up to the last row would be summed up anew for each row.
    """
    combine = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    held = rows.withColumn("_range", F.floor(F.col(at) / (width or RANGE))).withColumn("_value", value)
    span = Window.partitionBy(*keys, "_range").orderBy(*([c.desc() for c in order] if backward else order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    line = Window.partitionBy(*keys).orderBy(F.desc("_range") if backward else "_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*keys, "_range").agg(combine("_value").alias("_all"))
    named = {c: f"_c{i}" for i, c in enumerate((*keys, "_range"))}
    carried = sums.select(*[F.col(c).alias(n) for c, n in named.items()], combine("_all").over(line).alias("_carried"))
    own, carry = combine("_value").over(span), F.col("_carried")
    joined = F.coalesce(own + carry, own, carry) if how == "sum" else (F.greatest if how == "max" else F.least)(own, carry)
    both = held.join(carried, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()], "left")
    return both.withColumn(name, joined).drop("_range", "_value", "_carried", *named.values())


#: Rows that one task sorts, as far as keys allow.
TASK_ROWS = 1_000_000


def tasks_for(rows: DataFrame, n: int) -> int:
    """How many tasks sort n rows: more for a larger table, so that a task's memory doesn't grow with it."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_ROWS))


def in_one_range(rows: DataFrame, at: str, width: int | None = None) -> int:
    """In how many tasks a table's keys are to be scanned whole, as nothing is carried if all positions lie in one range; 0 if they lie in several. Reads that column once."""
    low, high, n = rows.select(F.floor(F.col(at) / (width or RANGE)).alias("_range")).agg(F.min("_range"), F.max("_range"), F.count("*")).first()
    return tasks_for(rows, n) if low == high else 0


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, order: list | None = None, width: int | None = None, tasks: int = 0) -> DataFrame:
    """Adds ``_island``, the first start of the run of intervals that overlap, or come within ``gap``.

    With ``tasks``, which ``in_one_range`` tells, one shuffle and one sort do, and rows stay where their keys are.
    """
    order = order or [F.col(start), F.col(end)]
    if tasks:
        line = Window.partitionBy(*keys).orderBy(*order)
        before = rows.repartition(tasks, *keys).withColumn("_before", F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1)))
        new = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + gap), F.col(start))
        return before.withColumn("_first", new).withColumn("_island", F.max("_first").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_first")
    before = running(rows, keys, start, order, F.col(end), "_before", "max", False, width=width)
    new = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + gap), F.col(start))
    return running(before.withColumn("_first", new).drop("_before"), keys, start, [*order, F.col("_first").asc_nulls_last()], F.col("_first"), "_island", "max", True, width=width).drop("_first")


def cut_at_gaps(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Adds ``_run``: rows of a key that differ in it are further apart than ``gap``.

    A run ends where a whole cell of ``gap`` + 1 places is empty. Only the occupied cells are sorted; rows are joined with them, and not shuffled while those are few.
    """
    from strandlake.session import staged

    held = rows.withColumn("_cell", F.floor(F.col(at) / (gap + 1)).cast("long"))
    names = {c: f"_c{i}" for i, c in enumerate((*keys, "_cell"))}
    cells = staged(islands(held.select(*keys, "_cell").distinct(), keys, "_cell", "_cell", 1).select(*[F.col(c).alias(n) for c, n in names.items()], F.col("_island").alias("_run")), "runs")
    return held.join(cells, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left").drop("_cell", *names.values())


def merged(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, width: int | None = None) -> DataFrame:
    """Islands of intervals that overlap, or come within ``gap``: keys, start, end, n."""
    marked = islands(rows.select(*keys, start, end), keys, start, end, gap, width=width, tasks=in_one_range(rows, start, width))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def stab_counts(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """For each point, how many closed intervals of its key hold it: begun up to it less ended before it."""
    p = points.select(key, F.col(point).alias("_at"), F.lit(1).alias("_kind")).distinct()
    events = (
        spans.select(key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_n"))
        .union(spans.select(key, (F.col(end) + 1).alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).alias("_n")))
        .groupBy(key, "_at", "_kind")
        .agg(F.sum("_n").alias("_n"))
    )
    line = events.union(p.withColumn("_n", F.lit(0).cast("long")))
    counted = running(line, [key], "_at", [F.col("_at"), F.col("_kind")], F.col("_n"), "stabbed", "sum", width=width)
    return counted.filter("_kind = 1").select(key, F.col("_at").alias(point), "stabbed")


def nearest(left: DataFrame, right: DataFrame, key: str, point: str, start: str, end: str, name: str, width: int | None = None) -> DataFrame:
    """The nearest interval of each point: ``name`` and ``distance``; ties go to the smaller start, then the smaller name.

    One pass over the sorted union: an interval that holds a point ends furthest right among those begun before, or the nearest ends last
    before the point, or begins first after it. No pairs are made.
    """
    a = left.select(key, F.col(point).alias("_at"), F.lit(1).alias("_kind")).distinct()
    nothing = F.lit(None)
    points = a.select(key, "_at", "_kind", nothing.cast("struct<e:bigint,s:bigint,n:string>").alias("_before"), nothing.cast("struct<s:bigint,n:string,e:bigint>").alias("_after"))
    r = right.select(key, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(name).cast("string").alias("n"))
    begun = r.select(key, F.col("s").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("e"), (-F.col("s")).alias("s"), "n").alias("_before"), F.struct("s", "n", "e").alias("_after"))
    # of the intervals that begin at one place, one is the best from behind and one from ahead
    begun = begun.groupBy(key, "_at", "_kind").agg(F.max("_before").alias("_before"), F.min("_after").alias("_after"))
    line = points.unionByName(begun)
    order = [F.col("_at"), F.col("_kind")]
    found = running(line, [key], "_at", order, F.col("_before"), "_b", "max", width=width)
    found = running(found, [key], "_at", order, F.col("_after"), "_a", "min", False, True, width=width).filter("_kind = 1")
    behind, ahead = F.greatest(F.lit(0), F.col("_at") - F.col("_b.e")), F.col("_a.s") - F.col("_at")
    take = F.when(F.col("_a.s").isNull() | (behind <= ahead), True).otherwise(False)
    use = F.col("_b.e").isNotNull() & take
    return found.select(key, F.col("_at").alias(point), F.when(use, F.col("_b.n")).otherwise(F.col("_a.n")).alias(name), F.when(use, behind).otherwise(ahead).alias("distance"))


def density(rows: DataFrame, keys: list[str], pos: str, width: int) -> DataFrame:
    """Counts in bins of a fixed width."""
    return rows.groupBy(*keys, (F.floor(F.col(pos) / width) * width).alias("bin_start")).agg(F.count("*").alias("n"))
