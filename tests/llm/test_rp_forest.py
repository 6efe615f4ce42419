"""The forest of random projections: trees, queue, units, and recall and scores against all pairs."""

import math
from collections import Counter

import numpy as np
import pytest
from strandlake.llm import rp_forest
from strandlake.session import table

SCHEMA = "vec_id long, embedding array<float>, label int, key string, leaf int"


def valid(rows):
    keep = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and all(x is not None for x in v)]
    return [(i, v) for i, v in keep if len(v) and np.isfinite(v).all() and v.any()]


def exact(rows, k=5, every=50):
    """All of (query, rank, id, score) by all pairs; each row is a candidate of the others."""
    kept = valid(rows)
    dim = max((len(v) for _, v in kept), default=0)
    x = np.array([np.pad(v, (0, dim - len(v))) for _, v in kept]).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(axis=1))
    out = []
    for q, (i, _) in enumerate(kept):
        if i is None or i % every:
            continue
        score = (x * x[q]).sum(axis=1) / (norm * norm[q])
        others = sorted(((-s, j is None, j or 0, s) for p, ((j, _), s) in enumerate(zip(kept, score.tolist())) if p != q))[:k]
        out += [(i, r, None if none else j, s) for r, (_, none, j, s) in enumerate(others, 1)]
    return out


def near(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and math.isclose(x[3], y[3], rel_tol=1e-12) for x, y in zip(sorted(a, key=str), sorted(b, key=str)))


def test_every_leaf_comes_once_and_the_nearest_first():
    r = np.random.default_rng(0)
    points = rp_forest.units_of(r.normal(size=(600, 12)))
    forest = rp_forest.Forest(points, 4)
    places = forest.places(points)
    assert places.shape == (4, 600) and all(set(p) == set(range(16 * t, 16 * t + 16)) for t, p in enumerate(places.tolist()))
    others = rp_forest.units_of(r.normal(size=(300, 12)))  # points of the sample lie on cuts
    for row, leaves in zip(forest.places(others).T.tolist(), forest.search(others), strict=True):
        order = list(leaves)
        assert sorted(order) == list(range(64)) and set(order[:4]) == set(row)  # its own leaf of each tree


def test_budget_finds_its_share():
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16)) * 5
    points = rp_forest.units_of(np.concatenate([c + r.normal(size=(60, 16)) for c in centres])[r.permutation(1800)])
    forest = rp_forest.Forest(points, 6)
    loose, strict = (rp_forest.budget_share(forest, points, 5, t) for t in (0.5, 0.99))
    assert 0 < loose < strict < 0.6  # in clusters, few leaves do


ROWS = [
    *[(100 * i, [1.0, 2.0, 3.0]) for i in range(9)], *[(7 + i, [2.0, 4.0, 6.0]) for i in range(4)], (50, [4.0, 8.0, 12.0]), (150, None), (250, []), (350, [0.0, 0.0]), (450, [1.0, None]), (550, [float("nan"), 1.0]), (650, [float("inf")]),
    (None, [1.0, 2.0, 3.1]), (None, None), (3, [1.0]), (4, [-1.0]), (1000, [1e-30, 0.0, 1e-30]), (1050, [1e30, 1e30, -0.0]), (1100, [-0.0, 1.0, 0.0]), (1100, [0.0, 1.0, 0.0]), (1150, [5.0, 1.0]), (1150, [1.0, 5.0]), (11, [0.0, 1.0, 0.0, 0.5]),
]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_edge_cases(spark, k):
    frame = spark.createDataFrame([(i, v, 1, "k", 2) for i, v in ROWS], SCHEMA)
    assert near(list(map(tuple, rp_forest.nearest(frame, k).collect())), exact(ROWS, k))


def test_tables_of_one_and_none(spark):
    assert rp_forest.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rp_forest.nearest(spark.createDataFrame([(0, [0.0], 1, "k", 2)], SCHEMA)).count() == 0
    assert rp_forest.nearest(spark.createDataFrame([(0, [1.0, 2.0], 1, "k", 2)], SCHEMA)).count() == 0
    assert rp_forest.nearest(spark.createDataFrame([(1, [1.0, 2.0], 1, "k", 2), (2, [1.0, 2.0], 1, "k", 2)], SCHEMA)).count() == 0


def test_small_units_find_the_same(spark, monkeypatch):
    """All leaves are asked, in units of few rows and queries: the result is exact, copies and ties included."""
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 8)).round(2)
    rows = [(i, base[int(r.integers(0, 300)) if r.random() < 0.7 else 0].tolist()) for i in range(900)]
    frame = spark.createDataFrame([(i, v, 1, "k", 2) for i, v in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(rp_forest, "UNIT_ROWS", 20)
    monkeypatch.setattr(rp_forest, "UNIT_QUERIES", 3)
    monkeypatch.setattr(rp_forest, "PRODUCTS", 64)
    monkeypatch.setattr(rp_forest, "budget_share", lambda *x: 4.0)
    found = list(map(tuple, rp_forest.nearest(frame, 5, 9).collect()))
    assert near(found, exact(rows, 5, 9))


def test_recall_on_a_whole_table(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    found = list(map(tuple, rp_forest.nearest(rows).collect()))
    expected = exact([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    assert [x[:2] for x in sorted(found)] == [x[:2] for x in sorted(expected)]
    hits = Counter((q, i) for q, _, i, _ in found) & Counter((q, i) for q, _, i, _ in expected)
    assert sum(hits.values()) >= 0.93 * len(expected)
    scores = {(q, i): s for q, _, i, s in expected}
    assert all(math.isclose(s, scores[q, i], rel_tol=1e-13) for q, _, i, s in found if (q, i) in scores)
