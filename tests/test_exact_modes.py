"""Nothing is lost in silence: fixpoints in place of rounds, and exact modes beside the caps."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from strandlake.functions import evidence, stats
from strandlake.operators import calling, detectors, evaluation, graph, sketch
from strandlake.operators.selection import top_per_key


def test_matches_of_a_long_chain_of_pairs(spark):
    # each pair waits for the one before it: many rounds
    pairs = [(i, i, 2 * i) for i in range(9)] + [(i + 1, i, 2 * i + 1) for i in range(8)]
    found = evaluation.mutual_matches(spark.createDataFrame(pairs, "truth_id long, call_id long, distance long"))
    taken, used_t, used_c = [], set(), set()
    for t, c, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if t not in used_t and c not in used_c:
            taken.append((t, c, d))
            used_t.add(t)
            used_c.add(c)
    assert sorted(tuple(r) for r in found.collect()) == sorted(taken)


def test_ancestors_of_any_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)], "c long, p long")
    up = graph.ancestors(edges, "c", "p")
    assert up.filter("node = 0").agg(F.max("depth"), F.count("*")).first()[:] == (150, 151)
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "c long, p long"), "c", "p")


def test_all_matches_of_a_repeat():
    unit = "ACGTTGCAAGCTTACGGATC"
    query, reference = unit, "G".join([unit] * 100)
    assert len(calling.find_mems(query, reference, 15)) == 64
    assert len(calling.find_mems(query, reference, 15, None)) >= 100


def test_tree_chains_as_the_plain_one(monkeypatch):
    r = np.random.default_rng(5)
    for n in (5, 60, 400):
        mems = np.column_stack([r.integers(0, 500, n), r.integers(0, 500, n), r.integers(1, 40, n)])
        plain = calling.best_chain(mems, 120)
        monkeypatch.setattr(calling, "TREE_MATCHES", 0)
        tree = calling.best_chain(mems, 120)
        monkeypatch.undo()
        assert mems[tree, 2].sum() == mems[plain, 2].sum() and tree == plain


def test_caps_have_exact_modes(spark):
    r = random.Random(3)
    seq = "".join(r.choice("ACGT") for _ in range(40_000))
    assert len(detectors.minimizer_hashes(seq)) == 192 < len(detectors.minimizer_hashes(seq, most=None))
    assert detectors.minimizer_hashes(seq) == detectors.minimizer_hashes(seq, most=None)[:192]
    first, every = (detectors.off_reference_windows(seq, lambda w: 0.0, most=m) for m in (10, None))
    assert first[0][1] < len(seq) - 500 < every[0][1]
    reads = sorted({seq[i : i + 60] for i in range(0, 2400, 30)})
    whole = graph.greedy_assemble(reads, 20, most=None)
    assert whole == [seq[: 2400 - 30 + 60]] and whole != graph.greedy_assemble(reads, 20)
    # two reads share two hub anchors, but are no neighbours in the order of their ids
    rows = spark.createDataFrame([(i, h) for h in ("a", "b") for i in range(60)], "id long, h string")
    assert sketch.shared_anchor_pairs(rows, "id", 2, None).count() == 60 * 59 // 2 > sketch.shared_anchor_pairs(rows, "id", 2).count()


def test_one_pass_similarities_equal_the_shuffled_ones(spark, monkeypatch):
    r = random.Random(6)
    q = spark.createDataFrame([(i, f"{r.randrange(40)}") for i in range(5) for _ in range(20)], "query long, h string").distinct()
    ref = spark.createDataFrame([(i, f"{r.randrange(40)}") for i in range(30) for _ in range(15)], "reference long, h string").distinct()
    one = sorted(map(tuple, sketch.similarities(q, ref).collect()))
    monkeypatch.setattr(sketch, "BROADCAST_ROWS", 0)
    assert one == sorted(map(tuple, sketch.similarities(q, ref).collect())) and len(one) > 100


def test_adjustment_in_ranges(spark):
    r = random.Random(7)
    p = [round(r.random() ** 2, 3) for _ in range(500)] + [0.0, 1.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(-1, None)], "i long, p double")
    found = {x["i"]: x["q"] for x in stats.benjamini_hochberg(rows.repartition(5), "p", "q").collect()}
    order = sorted(range(len(p)), key=lambda i: p[i])
    upper = {x: sum(y <= x for y in p) for x in set(p)}
    least, expected = 1.0, {}
    for i in reversed(order):
        least = min(least, p[i] * len(p) / upper[p[i]])
        expected[i] = least
    assert found.pop(-1) is None and all(abs(found[i] - expected[i]) < 1e-12 for i in expected)


def test_tails_against_plain_sums():
    from math import comb

    for a, b, c, d in ((3, 2, 1, 7), (0, 0, 0, 0), (5, 0, 0, 5), (12, 30, 7, 90)):
        row, column, n = a + b, a + c, a + b + c + d
        exact = sum(comb(row, x) * comb(n - row, column - x) for x in range(a, min(row, column) + 1)) / comb(n, column) if n else 1.0
        assert abs(stats.fisher_right_value(a, b, c, d) - exact) < 1e-9
    assert abs(stats.binomial_tail_value(3, 9, 0.2) - sum(comb(9, x) * 0.2**x * 0.8 ** (9 - x) for x in range(3, 10))) < 1e-12


def test_staged_tables_can_be_deleted(spark):
    from strandlake import session

    held = session.staged(spark.range(5), "held")
    path = session._staged[-1]
    others, session._staged[:] = session._staged[:-1], [path]
    with session.temporary(spark):
        session.staged(spark.range(3), "inner")
        assert session._staged == [path]
    assert held.count() == 5 and session.forget_staged(spark) == 1 and not session._staged
    session._staged[:] = others
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_single_reference_calls_of_planted_events(spark):
    r = random.Random(11)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    a, b, c, d, new = dna(1500), dna(1500), dna(1500), dna(1500), dna(120)
    reference = a + b + c + d
    query = a + new + b[:700] + b[900:] + calling.reverse_complement(c[:400]) + c[400:] + d
    found = calling.single_reference_calls(query, reference)
    kinds = {(x[0], x[5]) for x in found}
    assert ("INS", 120) in kinds and ("DEL", 200) in kinds and any(k == "INV" and abs(n - 400) <= 20 for k, n in kinds)
    assert {x[8] for x in found} == {40.0} and {x[9] for x in found} == {"single_ref"} and len({x[6] for x in found}) == 1
    # parts in another order give several chains
    moved = calling.find_mems(c + a, a + b + c, 18)
    parts = calling.chains(moved, 5000, 64)
    assert len(parts) >= 2 and sum(int(p[:, 2].sum()) for p in parts) >= 2900
    rows = spark.createDataFrame([(1, query, reference), (2, None, reference)], "id long, q string, r string")
    assert {x["svtype"] for x in calling.call_rows(rows, ["id"], "q", "r", single=True).collect()} >= {"INS", "DEL", "INV"}


def test_scans_in_ranges_equal_whole_ones(spark):
    from strandlake.operators import intervals, selection

    r = random.Random(21)
    spans = [(r.choice("ab"), p, p + r.randint(0, 30), r.randint(0, 9), i) for i, p in enumerate(r.randint(-50, 900) for _ in range(160))]
    frame = spark.createDataFrame([*spans, (None, 5, 9, 1, 999), (None, 7, 8, 2, 998)], "k string, s long, e long, w long, i long")
    got = lambda f: sorted(map(tuple, f.collect()), key=str)
    whole, narrow = 10**9, 37
    for gap in (0, 12):
        assert got(intervals.merged(frame, ["k"], "s", "e", gap, narrow)) == got(intervals.merged(frame, ["k"], "s", "e", gap, whole))
        lists = {}
        for k, s, e, *_ in sorted(spans):
            own = lists.setdefault(k, [])
            if own and s <= own[-1][1] + gap:
                own[-1] = [own[-1][0], max(own[-1][1], e), own[-1][2] + 1]
            else:
                own.append([s, e, 1])
        assert got(intervals.merged(frame.filter("k IS NOT NULL"), ["k"], "s", "e", gap, narrow)) == sorted(((k, *x) for k, own in lists.items() for x in own), key=str)
    points = frame.select("k", F.col("w").alias("p")).union(frame.select("k", F.col("s").alias("p")))
    assert got(intervals.stab_counts(points, frame, "k", "p", "s", "e", narrow)) == got(intervals.stab_counts(points, frame, "k", "p", "s", "e", whole))
    named = frame.select("k", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("i").alias("n"))
    assert got(intervals.nearest(points, named, "k", "p", "gs", "ge", "n", narrow)) == got(intervals.nearest(points, named, "k", "p", "gs", "ge", "n", whole))
    events = frame.select("k", "s", F.col("w").alias("len"))
    assert got(selection.run_merge(events, ["k"], "s", "len", 4, narrow)) == got(selection.run_merge(events, ["k"], "s", "len", 4, whole))
    assert got(selection.non_overlapping(frame, ["k"], "s", "e", "w", 3, narrow)) == got(selection.non_overlapping(frame, ["k"], "s", "e", "w", 3, whole))
    clusters = got(selection.greedy_clusters(frame.select("k", "s", "i"), ["k"], "s", 9, narrow))
    assert clusters == got(selection.greedy_clusters(frame.select("k", "s", "i"), ["k"], "s", 9, whole))
    head, number, last = None, -1, None
    expected = []
    for k, s, _, _, i in sorted(spans, key=lambda x: (x[0], x[1], x[4])):
        if k != last:
            head, number, last = None, -1, k
        if head is None or s - head > 9:
            head, number = s, number + 1
        expected.append((k, s, i, number))
    assert [c for c in clusters if c[0]] == sorted(expected, key=str)
    sides = frame.select("k", F.col("i").alias("id"), F.col("s").alias("pos"), F.col("w").alias("len"))
    truth, calls = sides.filter("id % 2 = 0"), sides.filter("id % 2 = 1")
    assert got(selection.greedy_match(truth, calls, ["k"], 15, 5.0, narrow)) == got(selection.greedy_match(truth, calls, ["k"], 15, 5.0, whole))


def test_segments_that_are_alike_are_one_node(spark):
    r = random.Random(31)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    a, b = dna(600), dna(600)
    near = a[:300] + dna(4) + a[304:]  # same ends, nearly all k-mers
    ends = a[:12] + dna(576) + a[-12:]  # same bucket, nothing else
    rows = [("1", a, "x", False), ("2", near, "x", True), ("3", a, "x", None), ("4", ends, "x", False), ("5", b, "x", False), ("6", a, "y", False), ("7", "AC", "x", False)]
    node = {x["key"]: x["node"] for x in graph.collapsed(spark.createDataFrame(rows, "key string, seg string, ann string, rep boolean"), "key", "seg", "ann", "rep").collect()}
    assert node["1"] == node["2"] == node["3"] and len({node[k] for k in "124567"}) == 5
    import hashlib

    assert node["1"] == hashlib.md5(f"x|{near}".encode()).hexdigest()[:16]  # the representative came first
    # a bubble that two paths share is one call
    parts = [dna(200) for _ in range(5)]
    paths = {"ref": parts + [dna(500)], "p": parts[:2] + [parts[2] + parts[2]] + parts[3:], "q": parts[:2] + [parts[2] + parts[2]] + parts[3:], "s": parts[:2] + parts[3:]}
    steps = spark.createDataFrame([("k", p, "c", i, s) for p, own in paths.items() for i, s in enumerate(own)], "clade string, path string, contig string, pos int, seg string")
    found = {(x["svtype"], x["ref_len"], x["alt_len"]): x["paths"] for x in graph.bubble_calls(steps, "clade", "path", "contig", "pos", "seg").collect()}
    assert found == {("DUP", 200, 400): ["p", "q"], ("DEL", 200, 0): ["s"]}


@pytest.mark.parametrize(("measure", "digits", "k"), [("jaccard", 6, 3), ("containment", None, 1), ("overlap", None, 4), ("jaccard", 1, 2)])
def test_best_pairs_hold_the_best_of_all_pairs(spark, monkeypatch, measure, digits, k):
    r = random.Random(16)
    sets = [(i, i % 3, {f"{r.randrange(60)}" for _ in range(r.randrange(1, 20))}) for i in range(150)]
    sets += [(200 + i, i % 2, sets[0][2]) for i in range(40)]
    ref = spark.createDataFrame([(i, p if i % 7 else None, h) for i, p, s in sets for h in s], "reference long, part int, h string")
    q = ref.filter("reference % 10 = 0").select(F.col("reference").alias("query"), "h")
    score = F.round(F.col(measure), digits) if digits else F.col(measure)
    every = sketch.similarities(q, ref.select("reference", "h")).withColumn("overlap", F.greatest("jaccard", "containment")).filter("query != reference")
    monkeypatch.setattr(sketch, "PAIRS_AT_ONCE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for part in (None, "part"):
            for last in (False, True):
                whole = every.join(ref.select("reference", "part").distinct(), "reference")
                order = [score.desc(), F.col("reference").desc() if last else F.col("reference")]
                keys, columns = (["query", part], ["query", "reference", "shared", measure]) if part else (["query"], ["query", "reference", "shared", measure])
                some = sketch.best_pairs(q, ref, k, measure, digits, part, last, True).cache()
                best = [sorted(map(tuple, top_per_key(x, keys, order, k).select(columns).collect())) for x in (whole, some)]
                assert best[0] == best[1] and some.count() < whole.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_similarities_of_ends_hold_one_pair_of_texts_at_a_time():
    texts = pa.array([f"{i}" + "x" * 200_000 for i in range(40)])
    tracemalloc.start()
    try:
        found = evidence.end_similarity.func(texts, texts)
        assert found.to_pylist() == [1.0] * 40 and tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("most", [30, 0])
def test_best_pairs_of_more_postings_than_a_worker_holds(spark, monkeypatch, most):
    ref = spark.createDataFrame([(i, i % 2, f"{(i * 7 + j) % 40}") for i in range(30) for j in range(8)], "reference long, part int, h string")
    # most of the query's postings are of no reference
    q = spark.createDataFrame([(3, f"{j}") for j in range(60)] + [(3, f"{j}x") for j in range(60)], "query long, h string").filter("h < '3'")
    rank = lambda x: sorted(map(tuple, top_per_key(x, ["query", "part"], [F.col("containment").desc(), F.col("reference")], 2).select("query", "reference", "part", "shared", "containment").collect()))
    whole = rank(sketch.best_pairs(q, ref, 2, "containment", part="part", drop_self=True))
    monkeypatch.setattr(sketch, "INDEX_POSTINGS", most)
    assert rank(sketch.best_pairs(q, ref, 2, "containment", part="part", drop_self=True)) == whole and len(whole) == 4
