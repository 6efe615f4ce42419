"""Representatives in order of quality, and calls without their shadows, against plain loops."""

import random

import pytest
from strandlake.operators import selection


@pytest.mark.parametrize("places", [1, 2])
def test_representatives(spark, places):
    r = random.Random(places)
    rows = [(i, r.choice("ab"), *(r.choice([None, *range(0, 120)]) if r.random() < 0.1 else r.randint(0, 120) for _ in range(2)), r.randint(0, 6)) for i in range(300)]
    rows += [(300 + i, "hot", 50, 50, 3) for i in range(80)]  # one place
    kept, expected = [], {}
    for i, k, *at, v in sorted(rows, key=lambda x: (x[4], x[0])):
        at = at[:places]
        if None in at:
            expected[i] = i
            continue
        hit = next((j for j, other, there in kept if other == k and all(abs(a - b) <= 9 for a, b in zip(at, there))), None)
        expected[i] = i if hit is None else hit
        if hit is None:
            kept.append((i, k, at))
    frame = spark.createDataFrame(rows, "id long, k string, x long, y long, v int")
    found = selection.represented(frame, ["k"], "id", ["x", "y"][:places], ["v"], 9).collect()
    assert {x["id"]: x["representative"] for x in found} == expected and len(found) == len(rows)
    assert selection.represented(frame.limit(0), ["k"], "id", ["x"], ["v"], 9).count() == 0


def test_calls_without_shadows(spark):
    rows = [
        ("q", "c1", "INV", 1000, 3000, 2000, 9.0, None, None), ("q", "c1", "INV", 1500, 2600, 1100, 5.0, None, None), ("q", "c1", "INV", 40_000, 42_000, 2000, 1.0, None, None), ("p", "c1", "INV", 1000, 3000, 2000, 1.0, None, None),
        ("q", "c1", "TRA", 500, 500, 0, 4.0, "c2", 9000), ("q", "c2", "TRA", 9100, 9100, 0, 8.0, "c1", 650), ("q", "c1", "TRA", 500, 500, 0, 1.0, "c2", 90_000), ("q", "c1", "TRA", 510, 510, 0, 1.0, "c2", 0), ("q", "c1", "TRA", 520, 520, 0, 1.0, ".", 7),
        ("q", "c3", "BND", 30_000, 30_000, 0, 3.0, "c3", 200), ("q", "c3", "BND", 250, 250, 0, 2.0, "c3", 30_100),
        ("q", "c1", "DEL", 1000, 3000, 2000, 9.0, None, None), ("q", "c1", "DEL", 1000, 3000, 2000, 9.0, None, None),
    ]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, query_asm string, contig string, svtype string, pos long, end long, svlen long, block_score double, mate_contig string, mate_pos long")
    left = {x["id"] for x in selection.without_shadows(frame, "id").collect()}
    assert left == {0, 2, 3, 5, 6, 7, 8, 9, 11, 12}  # mates that are swapped meet
