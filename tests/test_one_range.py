"""Islands, choices and matches of tables whose positions lie in one range: one shuffle, tasks of bounded size, and the rows of several ranges."""

import random

import pytest
from strandlake.operators import intervals, selection

KINDS = "k string, s long, e long, v int"


@pytest.fixture()
def rows(spark):
    r = random.Random(5)
    at = [(r.choice(["a", "b", None]), r.choice([None, *range(0, 900)]), r.randint(0, 9)) for _ in range(600)]
    return spark.createDataFrame([(k, s, s and s + r.randint(0, 6), v) for k, s, v in at], KINDS)



def test_one_shuffle(spark, rows):
    for found in (selection.non_overlapping(rows, ["k"], "s", "e", "v", 2), intervals.merged(rows, ["k"], "s", "e")):
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_more_rows_more_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(intervals, "TASK_ROWS", 50)
    assert intervals.in_one_range(rows, "s") == 12 and intervals.in_one_range(rows, "s", 100) == 0
    assert selection.non_overlapping(rows, ["k"], "s", "e", "v", 2).rdd.getNumPartitions() == 12


def test_as_in_several_ranges(rows):
    known = rows.filter("s IS NOT NULL")
    truth, calls = (known.selectExpr("k", "v * 1000 + s AS id", "s AS pos", "v AS len").filter(f"v % 2 = {i}").distinct() for i in (0, 1))
    for run in (
        lambda width: selection.non_overlapping(known, ["k"], "s", "e", "v", 2, width),
        lambda width: selection.greedy_clusters(known, ["k"], "s", 3, width),
        lambda width: selection.greedy_match(truth, calls, ["k"], 4, 10.0, width),
        lambda width: selection.run_merge(known.withColumnRenamed("v", "n_"), ["k"], "s", "n_", 3, width),
        lambda width: intervals.merged(known, ["k"], "s", "e", 1, width),
    ):
        one, several = (sorted(map(str, run(width).collect())) for width in (None, 70))
        assert one == several and one
