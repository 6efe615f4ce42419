"""Pairs of reads with common anchors, none lost, against all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest
from strandlake.operators import sketch
from strandlake.session import staged

from tests.measured import shuffled


def pairs_of(sets, least):
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = {i: s for s, i in first.items()}
    return {(a, b, len(reps[a] & reps[b])) for a, b in combinations(sorted(reps), 2) if len(reps[a] & reps[b]) >= least}, {i: first[frozenset(s)] for i, s in sets.items()}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_no_pair_is_lost(spark, least):
    r = random.Random(least)
    sets = {i: {r.choice(["hub", "hub2", "hub3"]) for _ in range(r.randint(0, 3))} | {f"h{r.randint(0, 60)}" for _ in range(r.randint(0, 6))} for i in range(150)}
    sets = {i: s for i, s in sets.items() if s}
    sets |= {200 + i: {"hub", "copy", "x"} for i in range(20)}
    rows = [(i, h) for i, s in sets.items() for h in s] + [(200, "hub")]
    classes = sketch.anchor_classes(spark.createDataFrame(rows, "read long, h string").repartition(3), "read")
    expected, members = pairs_of(sets, least)
    assert {r["read"]: r["representative"] for r in classes.collect()} == members
    found = list(map(tuple, sketch.exact_anchor_pairs(classes, "read", least).collect()))
    assert set(found) == expected and len(found) == len(expected)


def test_a_hub_of_ten_thousand_reads_ends(spark):
    """All reads have one anchor in common, and each one with its neighbour."""
    rows = spark.range(10_000).selectExpr("id AS read", "explode(array('hub', concat('a', id), concat('a', id + 1))) AS h")
    classes = sketch.anchor_classes(rows, "read")
    assert sketch.exact_anchor_pairs(classes, "read").count() == 9_999
    assert sketch.exact_anchor_pairs(classes.limit(0), "read").count() == 0


def test_many_cells_and_members(spark, monkeypatch):
    """Sets dealt into many blocks, counted some at a time: all pairs once, the smaller id first, with what each stands for."""
    monkeypatch.setattr(sketch, "CELL_POSTINGS", 60)
    monkeypatch.setattr(sketch, "COUNTED", 7)
    r = random.Random(5)
    sets = {f"r{i}": {f"h{r.randint(0, 40)}" for _ in range(r.randint(1, 8))} for i in range(200)} | {f"c{i}": {"h1", "h2", "h3"} for i in range(5)}
    expected, first = pairs_of(sets, 2)
    members = Counter(first.values())
    rows = spark.createDataFrame([(i, h) for i, s in sets.items() for h in s], "read string, h string")
    found = list(map(tuple, sketch.exact_anchor_pairs(sketch.anchor_classes(rows, "read"), "read", members=True).collect()))
    assert set(found) == {(a, b, n, members[a], members[b]) for a, b, n in expected} and len(found) == len(expected)


def test_no_set_is_sent_with_each_of_its_pairs(spark):
    """300 sets of 100 anchors make 44,850 pairs: sets are shuffled once for each block."""
    rows = spark.range(300).selectExpr("id AS read", "explode(transform(sequence(0, 99), i -> md5(cast(floor((i * 300 + id) / if(i < 3, 1000, 2)) AS string)))) AS h")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classes = staged(sketch.anchor_classes(rows, "read"), "classes")
        with shuffled(spark) as total:
            sketch.exact_anchor_pairs(classes, "read").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 0 < total[0] < 300 * 100 * 32 * 10
