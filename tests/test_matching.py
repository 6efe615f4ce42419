"""Matches by scans of sorted places, against the same matches from all pairs; no pairs are made."""

import random

import pytest
from pyspark.sql import functions as F
from strandlake.operators import evaluation


def sides(spark, rows, kind):
    return spark.createDataFrame(rows, f"{kind}_id string, {kind}_order int, query_asm string, svtype string, pos long, svlen long").selectExpr("*", "'k' AS contig", "pos % 2 = 0 AS same_scenario", "'S' AS scenario")


@pytest.mark.parametrize("seed", range(3))
def test_turns_as_by_pairs(spark, seed):
    r = random.Random(seed)
    some = lambda name, n: [(f"{name}{i}", i, r.choice("ab"), r.choice(["DEL", "INS"]), r.choice([None, *[r.randint(0, 400) // 9 * 9] * 30]), r.choice([None, *[r.randint(1, 30)] * 30])) for i in range(n)]
    truth, found = sides(spark, some("t", 150), "truth"), sides(spark, some("c", 200), "call")
    expected = set(map(tuple, evaluation.file_order_matches(evaluation.within_window(truth, found, 9)).collect()))
    rows = evaluation.matched_in_turn(truth, found, 9, ("query_asm", "pos")).collect()
    assert {(x["truth_id"], x["call_id"], x["distance"]) for x in rows if x["truth_id"]} == expected and len(expected) > 40
    assert len(rows) == 200 and {(x["call_id"], x["query_asm"], x["pos"]) for x in rows} == {(x["call_id"], x["query_asm"], x["pos"]) for x in found.collect()}


def test_a_place_of_all_calls_ends(spark):
    """All calls wait for one another at one place; their pairs would be 400 million, in 10,000 rounds."""
    rows = lambda kind: spark.range(20_000).select(F.col("id").cast("string").alias(f"{kind}_id"), F.col("id").alias(f"{kind}_order"), F.lit("a").alias("query_asm"), F.lit("k").alias("contig"), F.when(F.col("id") % 2 == 0, "INS").otherwise("DEL").alias("svtype"), F.lit(5).cast("long").alias("pos"), (F.col("id") % 9).alias("svlen"), F.lit("S").alias("scenario"), F.lit(True).alias("same_scenario"))
    found = evaluation.two_axis(rows("truth"), rows("call"), 9).filter("scenario = 'PANEL'").collect()
    assert [(x["tp"], x["fp"], x["fn"]) for x in found] == [(20_000, 0, 0)] * 2


@pytest.mark.parametrize("seed", range(3))
def test_nearest_as_by_pairs(spark, seed):
    """Ids have several places, some beyond a gap; against the matches of all pairs."""
    r = random.Random(seed)
    some = lambda n: [(r.choice("ab"), r.choice([r.randint(0, 60), 500 + r.randint(0, 60)])) for _ in range(n)]
    ids = lambda rows, far: [(k, 2 * (r.randint(0, 60) + (0 if far or p < 500 else 100)) + (k == "b"), p) for k, p in rows]
    truth, found = ids(some(80), seed == 1), ids(some(90), seed == 1)
    pairs = {(t, c, abs(p - q)) for k, t, p in truth for j, c, q in found if k == j and abs(p - q) <= 9}
    expected, used_t, used_c = set(), set(), set()
    for d, t, c in sorted((d, t, c) for t, c, d in pairs):
        if t not in used_t and c not in used_c:
            used_t.add(t), used_c.add(c)
            expected.add((t, c, d))
    frame = lambda rows, name: spark.createDataFrame(rows, f"k string, {name} long, pos long")
    rows = evaluation.nearest_matches(frame(truth, "truth_id"), frame(found, "call_id"), "k", 9).collect()
    assert set(map(tuple, rows)) == expected and len(rows) == len(expected) > 20


def test_nearest_at_few_places_ends(spark):
    """Forty thousand rows a side at ten places; their pairs would be more than a billion."""
    rows = lambda name: spark.range(40_000).selectExpr("'a' AS k", f"id AS {name}", "id % 10 AS pos")
    found = evaluation.nearest_matches(rows("truth_id"), rows("call_id"), "k", 9).agg(F.count("*"), F.sum("distance"), F.count_if(F.col("truth_id") == F.col("call_id"))).first()
    assert tuple(found) == (40_000, 0, 40_000)
