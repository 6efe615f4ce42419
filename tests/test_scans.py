"""Scans of sorted groups, chosen intervals, tests from cumulative tables, next values in order."""

import bisect
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.functions import stats
from strandlake.operators import graph, selection


def test_chosen_intervals(monkeypatch):
    monkeypatch.setattr(selection.Chosen, "MOST", 4)
    r, chosen, plain = random.Random(2), selection.Chosen(), []
    for _ in range(600):
        a = r.randint(0, 5000)
        at = bisect.bisect_left(plain, (a,))
        before, after = chosen.around(a)
        assert before == (plain[at - 1] if at else (-math.inf, -math.inf)) and after == (plain[at] if at < len(plain) else (math.inf, math.inf))
        if before[1] < a and a + 3 < after[0]:
            chosen.add(a, a + 3)
            bisect.insort(plain, (a, a + 3))
    assert [x for run in chosen.runs for x in run] == plain and max(map(len, chosen.runs)) <= 4


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_groups_come_whole_and_once(spark, batch):
    r = random.Random(batch)
    rows = [(r.choice([None, "a", "b", "c", "d"]), r.choice([None, 1, 2]), i) for i in range(300)] + [("hot", 1, i) for i in range(300, 700)]
    frame = spark.createDataFrame(rows, "k string, g int, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)

    def work(table, cuts):
        import pyarrow as pa

        sizes = np.diff(cuts)
        first = table.take(pa.array(cuts[:-1]))
        return pa.table({"k": first.column("k"), "g": first.column("g"), "n": pa.array(sizes), "low": first.column("i")})

    try:
        found = selection._scanned(frame, ["k", "g"], [F.col("i")], "k string, g int, n long, low long", work).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    expected = {}
    for k, g, i in rows:
        n, low = expected.get((k, g), (0, i))
        expected[k, g] = (n + 1, min(low, i))
    assert {(x["k"], x["g"]): (x["n"], x["low"]) for x in found} == expected and len(found) == len(expected)


def test_a_large_island_takes_time_in_proportion(spark):
    """Intervals that overlap without a gap: one group, many batches."""
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("c"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 15).alias("e"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("v"))
        begun = time.time()
        kept = selection.non_overlapping(rows, ["c"], "s", "e", "v", 0).count()
        assert n / 3 < kept < n / 2
        return time.time() - begun

    seconds(20_000)
    small, large = seconds(100_000), seconds(400_000)
    assert large < 10 * small + 5


def test_tails_from_cumulative_tables(spark):
    r = random.Random(4)
    tables = [tuple(r.choice([0, 1, 5, 40, 300]) for _ in range(4)) for _ in range(200)] + [(0, 0, 0, 0), (5, 0, 0, 0)]
    found = stats.fisher_right_values(*np.array(tables).T)
    assert all(math.isclose(f, stats.fisher_right_value(*x), rel_tol=1e-9, abs_tol=1e-300) for f, x in zip(found, tables, strict=True))
    counts = [(r.choice([-1, 0, 1, 7, 90, 400]), r.choice([0, 1, 50, 400]), r.choice([0.0, 0.1, 0.5, 1.0])) for _ in range(200)]
    found = stats.binomial_tail_values(*(np.array(c) for c in zip(*counts, strict=True)))
    assert all(math.isclose(f, stats.binomial_tail_value(*x), rel_tol=1e-9, abs_tol=1e-300) for f, x in zip(found, counts, strict=True))
    means = [(r.choice([0.0, 1.5]), r.choice([0.0, 2.0]), r.choice([0, 3]), r.choice([0.0, 1.5]), r.choice([0.0, 2.0]), r.choice([0, 9])) for _ in range(100)]
    found = stats.welch_values(*(np.array(c) for c in zip(*means, strict=True)))
    assert all(math.isclose(f, stats.welch_value(*x), rel_tol=1e-12) for f, x in zip(found, means, strict=True))
    frame = spark.createDataFrame([(1, 2, 3, 4), (None, 2, 3, 4)], "a int, b int, c int, d int").select(stats.fisher_right("a", "b", "c", "d").alias("p")).collect()
    assert frame[0]["p"] == pytest.approx(stats.fisher_right_value(1, 2, 3, 4)) and frame[1]["p"] is None


def test_the_next_value(spark):
    values = [5, 1, 1, 9, 40, 41, None, 7]
    found = stats.following(spark.createDataFrame([(v,) for v in values], "v long").repartition(4), "v", "next").collect()
    assert {r["v"]: r["next"] for r in found} == {None: 1, 1: 5, 5: 7, 7: 9, 9: 40, 40: 41, 41: None}
    assert stats.following(spark.createDataFrame([], "v long"), "v", "next").count() == 0


def test_alike_segments_share_a_node(spark):
    base = "ACGTTGCAAGGCTTACGATCGATTACCGGTAGCTAACGTTTGACGGATCCATGCA"
    near = base[:30] + "A" + base[31:]
    far = base[:12] + "".join(random.Random(1).choice("ACGT") for _ in range(len(base) - 24)) + base[-12:]
    rows = spark.createDataFrame([("1", near, "x", False), ("2", base, "x", True), ("3", far, "x", False), ("4", base, "y", False), ("5", base, "x", False)], "key string, seq string, a string, rep boolean")
    found = {r["key"]: r["node"] for r in graph.collapsed(rows, "key", "seq", "a", "rep").collect()}
    assert found["1"] == found["2"] == found["5"] and len({found["2"], found["3"], found["4"]}) == 3
