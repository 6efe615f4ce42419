"""Kernels and operators against literals, planted events and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.functions import scores as S
from strandlake.functions import sequence as Q
from strandlake.functions import stats
from strandlake.operators import calling, detectors, evaluation, graph, intervals, lookup, selection, sketch


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sequence_functions(spark):
    s = F.lit("ACGTNacgtGATTACA")
    r = one(spark, Q.reverse_complement(s), Q.gc_content(F.lit("GGCA")), Q.kmers(F.lit("ACGTA"), 3), Q.canonical(F.lit("TTT")), Q.translate_codons(F.lit("ATGTAAGCN")), Q.longest_orf(F.lit("ATGGCCTAAATG")), Q.low_complexity(F.lit("AAAAAAAA")), Q.low_complexity(F.lit("ACGTTGCAAC")), Q.positional_windows(F.lit(25), 10, 2))
    assert r[0] == "TGTAATCACGTNACGT" and r[1] == 0.75
    assert r[2] == ["ACG", "CGT", "GTA"] and r[3] == "AAA" and r[4] == "M*X" and r[5] == 2 and r[6] and not r[7] and r[8] == [0, 8, 15]
    short = one(spark, Q.kmers(F.lit("AC"), 3), Q.gc_content(F.lit("")), Q.hamming(F.lit("ACGT"), F.lit("ACCA")), Q.bounded_view(F.lit("abcdefghij"), 6, 2), Q.dinucleotide(F.lit("TATATA"), "TA"))
    assert short[0] == [] and short[1] == 0 and short[2] == 2 and short[3] == "abefij" and short[4] == 3


def test_karlin_agrees_with_its_kernel(spark):
    a, b = dna(400, 1), dna(400, 2)
    assert math.isclose(one(spark, Q.karlin_distance(F.lit(a), F.lit(b)))[0], detectors.karlin(a, b), rel_tol=1e-9)


def test_scores(spark):
    low, high = S.wilson(F.lit(8), F.lit(10))
    r = one(spark, F.round(low, 4), F.round(high, 4), S.sigmoid(F.lit(0.0)), S.topology(F.lit(1), F.lit(5), F.lit(7), F.lit(9)), S.topology(F.lit(1), F.lit(9), F.lit(2), F.lit(3)), S.inversion_lengths_agree(F.lit(100), F.lit(110)), S.interval_distance(F.lit(1), F.lit(5), F.lit(9), F.lit(12)), S.size_bin(F.lit(-100)))
    assert tuple(r) == (0.4902, 0.9433, 0.5, "PROPERLY_TRIALLELIC", "NESTED", True, 4, "51-100")
    tiers = one(spark, *[S.novelty_tier(F.lit(x)) for x in (0.0, 0.049, 0.05, 0.199, 0.20)])
    assert list(tiers) == ["NOVEL", "NOVEL_WEAK", "DIVERGED", "DIVERGED", "OFF_REF_KNOWN"]
    assert one(spark, S.cross_clade_tier(F.lit(0.02), F.lit(0.30)))[0] == "HGT_CROSS_CLADE"


def test_evidence_fusion(spark):
    rows = spark.createDataFrame([("ASM", -3.0, 2.0, 1.0, 60, 1.0, 1.0), ("LR", -2.0, 1.5, 18.0, 50, 0.9, 0.8), ("SR", -1.0, 0.8, 65.0, 45, 0.8, 0.7)], "layer string, ref double, alt double, depth double, mapq int, bp double, span double")
    w = S.evidence_weight(*[F.col(c) for c in ("layer", "depth", "alt", "ref", "mapq", "bp", "span")])
    assert rows.agg(S.sigmoid(S.logit(F.lit(0.2)) + F.sum(w))).first()[0] > 0.8


def test_statistics(spark):
    assert math.isclose(stats.fisher_right_value(3, 1, 1, 3), 17 / 70)
    assert math.isclose(stats.binomial_tail_value(2, 3, 0.5), 0.5) and stats.binomial_tail_value(0, 3, 0.5) == 1
    assert stats.welch_value(1, 0, 2, 1, 0, 2) == 1 and stats.welch_value(1, 0, 2, 2, 0, 2) == 0
    rows = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert sorted(round(r["q"], 6) for r in stats.benjamini_hochberg(rows, "p", "q").collect()) == [0.03, 0.04, 0.04]
    assert [int(h) for h in stats.fnv1a(__import__("pandas").Series(["", "a"]))] == [14695981039346656037, 0xAF63DC4C8601EC8C]


def test_intervals(spark):
    spans = spark.createDataFrame([("c", 10, 30), ("c", 20, 40), ("c", 50, 70)], "k string, s long, e long")
    points = spark.createDataFrame([("c", 25), ("c", 55), ("c", 45)], "k string, p long")
    assert {r["p"]: r["stabbed"] for r in intervals.stab_counts(points, spans, "k", "p", "s", "e").collect()} == {25: 2, 55: 1, 45: 0}
    merged = spark.createDataFrame([("c", 1, 5), ("c", 4, 8), ("c", 10, 12)], "k string, s long, e long")
    assert sorted((r["s"], r["e"]) for r in intervals.merged(merged, ["k"], "s", "e").collect()) == [(1, 8), (10, 12)]
    r = random.Random(1)
    a = [("c", s, s + r.randint(0, 300)) for s in (r.randint(0, 3000) for _ in range(60))]
    b = [("c", i, s, s + r.randint(0, 300)) for i, s in enumerate(r.randint(0, 3000) for _ in range(60))]
    left, right = spark.createDataFrame(a, "k string, s long, e long"), spark.createDataFrame(b, "k string, i long, gs long, ge long")
    found = sorted((x["s"], x["e"], x["i"]) for x in intervals.overlap_join(left, right, "k", ("s", "e"), ("gs", "ge"), 64, 3).collect())
    assert found == sorted((s, e, i) for _, s, e in a for _, i, gs, ge in b if gs <= e + 3 and ge >= s - 3)
    near = intervals.nearest(left, right, "k", "s", "gs", "ge", "i").collect()
    assert {x["s"]: x["distance"] for x in near} == {s: min(max(0, gs - s, s - ge) for _, _, gs, ge in b) for _, s, _ in a}


def test_selection_against_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), p, p + r.randint(1, 60), float(r.randint(0, 9)), i) for i, p in enumerate(r.randint(0, 900) for _ in range(150))]
    frame = spark.createDataFrame(rows, "k string, s long, e long, score double, id long")
    kept = []
    for row in sorted(rows, key=lambda x: (-x[3], x[1], x[2], x[4])):
        if all(k[0] != row[0] or k[2] + 20 < row[1] or row[2] + 20 < k[1] for k in kept):
            kept.append(row)
    assert sorted(tuple(x) for x in selection.non_overlapping(frame, ["k"], "s", "e", "score", 20).collect()) == sorted(kept)
    clusters = selection.greedy_clusters(frame.select("k", "s", "id"), ["k"], "s", 30).collect()
    for k in "ab":
        own, head, n = sorted((x["s"], x["id"], x["cluster"]) for x in clusters if x["k"] == k), None, -1
        for s, _, c in own:
            if head is None or s - head > 30:
                head, n = s, n + 1
            assert c == n
    t = [("a", i, r.randint(0, 3000), r.randint(1, 90)) for i in range(80)]
    c = [("a", i, r.randint(0, 3000), r.randint(1, 90)) for i in range(80)]
    schema = "k string, id long, pos long, len long"
    pairs = sorted((abs(x[2] - y[2]) + abs(x[3] - y[3]), x[1], y[1]) for x in t for y in c if abs(x[2] - y[2]) <= 200 and abs(x[3] - y[3]) <= 0.5 * max(1, x[3]))
    used_t, used_c, expected = set(), set(), set()
    for d, i, j in pairs:
        if i not in used_t and j not in used_c:
            used_t.add(i), used_c.add(j), expected.add((i, j, d))
    found = selection.greedy_match(spark.createDataFrame(t, schema), spark.createDataFrame(c, schema), ["k"], 200, 0.5)
    assert {(x["truth_id"], x["call_id"], x["distance"]) for x in found.collect()} == expected
    candidates = spark.createDataFrame([(i, j, d) for d, i, j in pairs], "truth_id long, call_id long, distance long")
    assert {tuple(x) for x in evaluation.mutual_matches(candidates).collect()} == expected


CALL = "id long, query_asm string, contig string, pos long, end long, svtype string, svlen long, source string, coord_space string, mate_contig string, mate_pos long"


def call(i, pos, end, kind, size=None, source="s"):
    return i, "q", "c", pos, end, kind, size if size is not None else end - pos, source, "query", None, None


@pytest.mark.parametrize(
    ("truth", "calls", "expected"),
    [
        ([], [call(1, 10, 60, "DEL")], (0, 1, 0, "no_truth")),
        ([call(1, 5000, 5200, "INV")], [call(2, 1000, 9000, "INV")], (1, 0, 0, "ok")),
        ([call(1, 105_000, 105_100, "DEL")], [call(2, 100_000, 112_000, "DEL")], (1, 0, 0, "ok")),
        ([call(i, 101_000 + 1000 * i, 101_100 + 1000 * i, "DEL") for i in range(5)], [call(9, 100_000, 112_000, "DEL")], (1, 0, 4, "ok")),
        ([call(1, 1000, 1000, "INS", 50), call(2, 1300, 1300, "INS", 50)], [call(3, 1200, 1200, "INS", 50), call(4, 800, 800, "INS", 50)], (2, 0, 0, "ok")),
        ([call(1, 1000, 1080, "DEL")], [call(2, 1000, 1100, "DEL")], (0, 1, 1, "ok")),
    ],
)
def test_callset_contracts(spark, truth, calls, expected):
    rows = evaluation.score_callsets(spark.createDataFrame(truth, CALL), spark.createDataFrame(calls, CALL))
    r = next(x for x in rows.collect() if x["svtype"] == "ALL")
    assert (r["tp"], r["fp"], r["fn"], r["status"]) == expected


def test_consensus_and_layers(spark):
    c = spark.createDataFrame([call(1, 1000, 1100, "DEL", source="A"), call(2, 1400, 1500, "DEL", source="A"), call(3, 1900, 2000, "DEL", source="B")], CALL)
    assert [r["pos"] for r in evaluation.consensus_truth(c, 500).collect()] == [1400]
    layers = [call(i, p, p + 50, k) + (s, n) for i, (p, k, s, n) in enumerate([(100, "DEL", True, 0), (110, "DEL", False, 0), (120, "DEL", False, 0), (5000, "INS", False, 0), (5010, "INS", False, 3)])]
    schema = CALL + ", single_reference boolean, read_support long"
    r = evaluation.call_layers(spark.createDataFrame(layers, schema)).first()
    assert (r[1], r[2], r[3], r[4], r[5]) == (5, 2, 1, 1, 1)


def test_mems_against_brute_force():
    q, r = dna(120, 5), dna(120, 5)[20:90] + dna(60, 6)
    expected = set()
    for i in range(len(q)):
        for j in range(len(r)):
            if q[i] == r[j] and (i == 0 or j == 0 or q[i - 1] != r[j - 1]):
                n = 0
                while i + n < len(q) and j + n < len(r) and q[i + n] == r[j + n]:
                    n += 1
                if n >= 12:
                    expected.add((i, j, n))
    assert {tuple(m) for m in calling.find_mems(q, r, 12).tolist()} == expected
    assert len(calling.find_mems("ACGT", "ACGTACGTACGT", 4)) == 3


def test_chain_events():
    chain = np.array([(0, 0, 50), (50, 100, 50)])
    assert [(c[0], c[-1]) for c in calling.classify_all(chain, 20)] == [("DEL", 50)]
    assert [(c[0], c[-1]) for c in calling.classify_all(np.array([(0, 0, 20), (70, 20, 20)]), 20)] == [("INS", 50)]
    mems = np.array([(0, 0, 20), (25, 25, 20), (50, 50, 20)])
    assert len(calling.best_chain(mems, 100)) == 3


def test_planted_events():
    a, b, c, d, other = (dna(300, i) for i in range(10, 15))
    ref = a + b + c + d
    kinds = lambda q: {x[0] for x in calling.call_pair(q, ref)}
    assert kinds(ref) == set()
    assert kinds(a + b[:100] + b[220:] + c + d) == {"DEL"}
    assert kinds(a + b + other[:120] + c + d) == {"INS"}
    assert kinds(a + calling.reverse_complement(b) + c + d) == {"INV"}
    assert kinds(a + b + b + c + d) == {"DUP"}
    deletion = calling.call_pair(a + b[:100] + b[220:] + c + d, ref)[0]
    assert deletion[5] == 120 and abs(deletion[1] - 401) <= 5
    assert {x[0] for x in calling.call_pair(b + c, ref, calling.CallParams(min_anchors=1), same_contig=False)} == {"TRA"}
    assert calling.call_pair("", ref) == [] and calling.call_pair(ref, "") == []


def test_detectors():
    flat = "".join(random.Random(1).choice("AT") for _ in range(2000))
    rich = "".join(random.Random(2).choice("GC") for _ in range(1500))
    half = dna(400, 3)
    assert detectors.is_tandem("ACG" * 20) and not detectors.is_tandem(dna(200, 4))
    end = dna(50, 5)
    assert detectors.is_ltr(end + "GC" * 100 + end)
    tip = dna(30, 6)
    assert detectors.is_tir(tip + dna(200, 7) + calling.reverse_complement(tip))
    assert detectors.is_line(flat[:300] + "A" * 12) and detectors.is_hgt_island(half + rich + half, 0.5)
    assert detectors.is_rip("TA" * 250) and not detectors.is_rip("CA" * 250)
    assert detectors.element_class("ACGT", 0.5) == "NONE"
    assert detectors.element_class(half + "".join(random.Random(2).choice("GGCCA") for _ in range(1500)) + half, 0.5) in ("HGT", "STARSHIP")
    assert detectors.donor_and_age(0.70, 0.50, 100.0, 400) == ("HIGHER_GC_DONOR", "RECENT")
    assert detectors.flank("TTACGTAC", "TTACGTAC")[0] == "TSD"
    start, stop = detectors.boundary(half + rich + half, 0.5)
    assert abs(start - 400) <= 200 and abs(stop - 1900) <= 200
    assert detectors.recombinase_score("M" + "A" * 9 + "R" + "A" * 79 + "H" + "AA" + "R" + "A" * 29 + "Y") == 1.0
    windows = detectors.off_reference_windows(dna(2000, 8), lambda w: 0.0)
    assert windows == [(0, 2000, 0.0, "NOVEL")]


def test_sketches(spark):
    a, b = F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [2, 3, 4]))
    empty = F.array().cast("array<int>")
    assert list(one(spark, sketch.jaccard_distance(a, b), sketch.jaccard_distance(empty, empty), sketch.jaccard_distance(a, empty))) == [0.5, 0.0, 1.0]
    rows = spark.createDataFrame([("A", h) for h in "1234"] + [("B", h) for h in "abcd"] + [("C", h) for h in "5678"], "reference string, h string")
    query = spark.createDataFrame([("q", h) for h in "1234"], "query string, h string")
    assert [tuple(r)[:4] for r in sketch.route_topk(query, rows, 2).collect()] == [("q", "A", 4, 1.0)]
    reads = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x")], "read long, h string")
    assert [tuple(r) for r in sketch.shared_anchor_pairs(reads, "read").collect()] == [(1, 2, 2)]
    seqs = spark.createDataFrame([(dna(300, 9),), (None,), ("ACG",)], "s string").select(detectors.open_syncmers("s").alias("y"), detectors.minimizers("s").alias("m")).collect()
    assert len(seqs[0]["y"]) > 5 and len(seqs[0]["m"]) >= 2 and seqs[1]["y"] == [] and seqs[2]["m"] == []


def test_graph(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (10, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.connected(links).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7}
    tree = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b")], "child string, parent string")
    up = graph.ancestors(tree, "child", "parent")
    pairs = spark.createDataFrame([("d", "e"), ("d", "c")], "x string, y string")
    assert {(r["x"], r["y"]): r["branch_point"] for r in graph.lowest_common(pairs, up, "x", "y").collect()} == {("d", "e"): "b", ("d", "c"): "a"}
    parts = spark.createDataFrame([("g1", 0, "A"), ("g1", 1, "X"), ("g1", 2, "B"), ("g2", 0, "A"), ("g2", 1, "Y"), ("g2", 2, "B")], "path string, pos int, segment string")
    nodes, steps, edges = graph.clade_graph(parts, "path", "pos", "segment")
    assert nodes.count() == 4 and edges.count() == 4
    assert [tuple(r)[2:] for r in graph.bubbles(steps, "path", "pos", 2).collect()] == [(2, 2)]
    genome = dna(400, 11)
    assert graph.greedy_assemble([genome[:150], genome[100:260], genome[220:], genome[30:90]], 20) == [genome]
    kmers = {}
    for i in range(len(genome) - 20):
        kmers[genome[i : i + 21]] = kmers.get(genome[i : i + 21], 0) + (2 if i == 0 else 1)
    assert graph.unitigs(spark.createDataFrame(list(kmers.items()), "k string, c int"), "k", "c").first()["seq"] == genome
    reads = spark.createDataFrame([(1, genome[:150]), (1, genome[100:])], "cluster long, seq string")
    assert graph.assembled(reads, "cluster", "seq").first()["seq"] == genome


def test_lookup(spark):
    left = spark.createDataFrame([(1, "x/GCA_1.2.fa"), (2, "S7"), (3, "none")], "id long, name string")
    right = spark.createDataFrame([("GCA_1.2", "p"), ("S7", "q")], "key string, value string")
    found = lookup.alias_join(left, right, lookup.name_aliases(F.col("name")), "key", ["id"])
    assert {r["id"]: r["value"] for r in found.collect()} == {1: "p", 2: "q", 3: None}
    info = one(spark, lookup.info_map(F.lit("A=1;FLAG;B=x=y")))[0]
    assert info == {"A": "1", "FLAG": "1", "B": "x=y"}


def test_expression_and_enrichment(spark):
    rows = [("a", "g", c, v) for c, v in (("control", 1.0), ("control", 1.2), ("stress", 24.0), ("stress", 20.0))]
    out = evaluation.expression_contrast(spark.createDataFrame(rows, "asm string, gene_id string, condition string, expression double"), ["asm", "gene_id"]).first()
    assert out["contrast"] == "stress_vs_control" and out["log2_fc"] > 2 and out["padj"] < 0.05
    calls = spark.createDataFrame([(True, True), (False, False), (False, False)], "unique boolean, te boolean")
    r = evaluation.enrichment(calls, "unique", ["te"]).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (1, 0, 0, 2) and math.isclose(r["p"], 1 / 3)
    sources = spark.createDataFrame([("q", "c", 1, 5, "DEL", "no"), ("q", "c", 1, 5, "DEL", "yes"), ("q", "c", 9, 9, "INS", "yes")], "query_asm string, contig string, pos long, end long, svtype string, read_validated string")
    assert tuple(evaluation.panel_rates(sources).first())[1:4] == (2, 2, 1.0)
    wins = spark.createDataFrame([("consensus",), ("consensus_read_supported",), ("minigraph_read_supported",)], "label string")
    assert [r["label"] for r in evaluation.wins_subset(wins, "label").collect()] == ["consensus_read_supported"]
