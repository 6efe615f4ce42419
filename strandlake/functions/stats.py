"""Statistics that the JVM lacks, on Arrow batches; and window forms of those it has."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Logarithms of factorials come from a table up to here; beyond it the first terms of Stirling's series are as exact as doubles.
TABLED = 1 << 20
_LOG_FACTORIAL = np.zeros(1)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log of n!; what is held does not grow with n."""
    global _LOG_FACTORIAL
    n = np.asarray(n)
    most = int(n.max(initial=0))
    if len(_LOG_FACTORIAL) <= min(most, TABLED):
        _LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, min(2 * most + 1024, TABLED + 1), dtype=np.float64)))])
    table = _LOG_FACTORIAL
    out = table[np.minimum(n, len(table) - 1)]
    if most < len(table):
        return out
    x = np.maximum(n, 1).astype(np.float64)
    return np.where(n < len(table), out, x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3))


def _log_choose(n: int, k: np.ndarray) -> np.ndarray:
    """log of n over k."""
    return _log_factorial(np.array(n)) - _log_factorial(k) - _log_factorial(n - k)


def _law(log_chance, low: int, high: int, mode: int) -> tuple[int, np.ndarray]:
    """The first value from ``low`` to ``high`` whose probability is not zero as a double, and the probabilities from there on; the law falls to both sides of ``mode``, so the rest is not computed."""

    def edge(inside: int, outside: int) -> int:
        some = lambda x: log_chance(np.array([x]))[0] > -746
        if some(outside):
            return outside
        while abs(inside - outside) > 1:
            middle = (inside + outside) // 2
            inside, outside = (middle, outside) if some(middle) else (inside, middle)
        return inside

    mode = min(max(mode, low), high)
    first = edge(mode, low)
    return first, np.exp(log_chance(np.arange(first, edge(mode, high) + 1)))


def fisher_right_value(a: int, b: int, c: int, d: int) -> float:
    """P(at least a) under the hypergeometric law of a 2x2 table."""
    row, column, n = a + b, a + c, a + b + c + d
    if n == 0:
        return 1.0
    x = np.arange(a, min(row, column) + 1)
    return min(1.0, float(np.exp(_log_choose(row, x) + _log_choose(n - row, column - x) - _log_choose(n, np.array(column))).sum()))


def binomial_tail_value(k: int, n: int, p: float) -> float:
    """P(at least k of n) at rate p."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    x = np.arange(k, n + 1)
    return min(1.0, float(np.exp(_log_choose(n, x) + x * math.log(p) + (n - x) * math.log1p(-p)).sum()))


def welch_value(m1: float, v1: float, n1: int, m2: float, v2: float, n2: int) -> float:
    """The two-sided normal p-value of a difference of means."""
    spread = math.sqrt(v1 / n1 + v2 / n2) if n1 and n2 else 0.0
    if spread == 0:
        return 1.0 if m1 == m2 else 0.0
    return math.erfc(abs(m1 - m2) / spread / math.sqrt(2))


def _tails(groups: np.ndarray, at: np.ndarray, table) -> np.ndarray:
    """Of each row the upper tail at ``at`` under its group's law: ``table(group)`` gives the first value and the probabilities from there on, once a group."""
    out = np.empty(len(at))
    distinct, of = np.unique(groups, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    cuts = np.searchsorted(of.ravel()[order], np.arange(len(distinct) + 1))
    for g, low, high in zip(distinct, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[low:high]
        first, chance = table(g)
        tail = np.append(np.cumsum(chance[::-1])[::-1], 0.0)
        out[own] = tail[np.clip(at[own] - first, 0, len(chance)).astype(np.int64)]
    return np.minimum(1.0, out)


def fisher_right_values(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``fisher_right_value`` of many tables: those with the same margins share one law."""

    def table(g: np.ndarray) -> tuple[int, np.ndarray]:
        row, column, n = (int(v) for v in g)
        return _law(lambda x: _log_choose(row, x) + _log_choose(n - row, column - x) - _log_choose(n, np.array(column)), max(0, row + column - n), min(row, column), (row + 1) * (column + 1) // (n + 2))

    return _tails(np.column_stack([a + b, a + c, a + b + c + d]), a, table)


def binomial_tail_values(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``binomial_tail_value`` of many counts: those with the same n and rate share one law."""
    out = np.where(k <= 0, 1.0, np.where((p <= 0) | (k > n), 0.0, 1.0))
    inner = np.flatnonzero((k > 0) & (p > 0) & (k <= n) & (p < 1))

    def table(g: np.ndarray) -> tuple[int, np.ndarray]:
        size, rate = int(g[0]), float(g[1])
        return _law(lambda x: _log_choose(size, x) + x * math.log(rate) + (size - x) * math.log1p(-rate), 0, size, int((size + 1) * rate))

    if len(inner):
        out[inner] = _tails(np.column_stack([n[inner].astype(np.float64), p[inner]]), k[inner], table)
    return out


_ERFC = np.frompyfunc(math.erfc, 1, 1)


def welch_values(m1: np.ndarray, v1: np.ndarray, n1: np.ndarray, m2: np.ndarray, v2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """``welch_value`` of many pairs."""
    some = (n1 > 0) & (n2 > 0)
    spread = np.sqrt(np.where(some, v1 / np.where(some, n1, 1) + v2 / np.where(some, n2, 1), 0.0))
    flat = spread == 0
    z = np.abs(m1 - m2) / np.where(flat, 1.0, spread) / math.sqrt(2)
    return np.where(flat, np.where(m1 == m2, 1.0, 0.0), _ERFC(z).astype(np.float64))


def _vectorized(function, kinds: tuple[type, ...]):
    """A pandas UDF of arrays of these kinds; a row with a null or NaN gives null."""

    @F.pandas_udf(T.DoubleType())
    def apply(*columns: pd.Series) -> pd.Series:
        missing = np.any([c.isna().to_numpy() for c in columns], axis=0)
        out = np.full(len(missing), np.nan)
        own = [c.to_numpy()[~missing].astype(kind) for c, kind in zip(columns, kinds, strict=True)]
        if (~missing).any():
            out[~missing] = function(*own)
        return pd.Series(out).astype("Float64").where(~missing, pd.NA)

    return apply


fisher_right = _vectorized(fisher_right_values, (np.int64,) * 4)
binomial_tail = _vectorized(binomial_tail_values, (np.int64, np.int64, np.float64))
welch = _vectorized(welch_values, (np.float64, np.float64, np.int64) * 2)


def following(rows: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): each distinct value and the next larger one, null for the last. Ranges of values are ordered apart; of each range one row goes to the one before."""
    from strandlake.session import staged

    ranged = rows.select(column).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged, "ranges")  # the ranges must not be drawn again
    inside = ranged.withColumn(out, F.lead(column).over(Window.partitionBy("_range").orderBy(column)))
    starts = ranged.groupBy("_range").agg(F.min(column).alias("_first"))
    ahead = starts.withColumn("_next", F.lead("_first").over(Window.orderBy("_range"))).select("_range", "_next")  # a row a range
    return inside.join(F.broadcast(ahead), "_range").select(column, F.coalesce(out, "_next").alias(out))


def benjamini_hochberg(rows: DataFrame, p: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Adjusted p-values: the running minimum of p * m / rank from the largest rank down, at most 1.

    Ranks come from counts by distinct p. Without ``keys`` the family is the whole table: distinct p-values then lie in ranges, each of which is scanned by
    itself, and one row a range (its count, its least adjusted value) carries ranks up and minima down. A null p stays null and is not counted.
    """
    keys = keys or []
    counts = rows.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    if not keys:
        return rows.join(_adjusted_in_ranges(counts, p, out), p, "left")
    order = Window.partitionBy(*keys).orderBy(p)
    ranked = counts.withColumn("_rank", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_m", F.sum("_c").over(Window.partitionBy(*keys)))
    adjusted = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(Window.partitionBy(*keys).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0))
    table = ranked.withColumn(out, F.least(F.lit(1.0), adjusted)).select(*keys, p, out)
    return rows.join(table, [*keys, p], "left")


def _adjusted_in_ranges(counts: DataFrame, p: str, out: str) -> DataFrame:
    from strandlake.session import staged

    part = staged(counts.repartitionByRange(p).withColumn("_part", F.spark_partition_id()), "ranges")
    own, line = Window.partitionBy("_part"), Window.orderBy("_part")  # the latter over one row a range
    sizes = part.groupBy("_part").agg(F.sum("_c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"), F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_m"))
    rank = F.col("_before") + F.sum("_c").over(own.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    each = part.join(F.broadcast(sizes), "_part").withColumn("_q", F.col(p) * F.col("_m") / rank)
    least = each.groupBy("_part").agg(F.min("_q").alias("_least"))
    later = least.select("_part", F.min("_least").over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    tail = F.min("_q").over(own.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return each.join(F.broadcast(later), "_part").select(p, F.least(F.lit(1.0), tail, F.col("_later")).alias(out))


def n50(rows: DataFrame, keys: list[str], length: str) -> DataFrame:
    """The length at which the running sum from the longest passes half the total.

    Equal lengths are counted first, so a window sorts distinct lengths, not rows.
    """
    counts = rows.groupBy(*keys, length).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    mass = F.col(length) * F.col("_c")
    running = F.sum(mass).over(w.orderBy(F.col(length).desc()).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(mass).over(w)
    return counts.withColumn("_run", running).withColumn("_all", total).filter(2 * F.col("_run") >= F.col("_all")).groupBy(*keys).agg(F.max(length).alias("n50"))


def log2_mean(x: Column, shift: float = 1.0) -> Column:
    return F.avg(F.log2(F.greatest(F.lit(0.0), x) + shift))


def sample_variance(x: Column) -> Column:
    """0 below two values."""
    return F.when(F.count(x) < 2, 0.0).otherwise(F.var_samp(x))


def fnv1a(strings: pd.Series) -> np.ndarray:
    """64-bit FNV-1a of each string, vectorised over strings by byte position."""
    raw = [s.encode() for s in strings]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    table = np.zeros((len(raw), int(n.max()) if len(raw) else 0), np.uint8)
    for i, r in enumerate(raw):
        table[i, : len(r)] = np.frombuffer(r, np.uint8)
    h = np.full(len(raw), 14695981039346656037, np.uint64)
    for j in range(table.shape[1]):
        h = np.where(j < n, (h ^ table[:, j]) * np.uint64(1099511628211), h)
    return h


@F.pandas_udf(T.LongType())
def fnv1a_hash(strings: pd.Series) -> pd.Series:
    """FNV-1a as a signed long; null for null."""
    known = strings.notna()
    out = pd.Series(np.zeros(len(strings), np.int64), dtype="Int64")
    out[known.to_numpy()] = fnv1a(strings[known]).view(np.int64)
    out[~known.to_numpy()] = pd.NA
    return out
