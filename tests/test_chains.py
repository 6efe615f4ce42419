"""Chains by pointer doubling, unitigs, matches in file order and ancestral bases, each against a plain loop."""

import random
from collections import Counter, defaultdict

import pytest
from strandlake.operators import calling, evaluation, graph


def test_chains_and_rings(spark):
    r = random.Random(3)
    names = [f"n{i:04}" for i in range(400)]
    r.shuffle(names)
    chains, at = [], 0
    for size in (1, 1, 2, 3, 4, 7, 8, 9, 31, 64, 65):
        chains.append(names[at : at + size])
        at += size
    rings = []
    for size in (2, 3, 8, 17, 50):
        rings.append(names[at : at + size])
        at += size
    links = [(a, b) for c in chains for a, b in zip(c, c[1:])] + [(a, b) for c in rings for a, b in zip(c, [*c[1:], c[0]])]
    nodes = [n for c in (*chains, *rings) for n in c]
    found = graph.ranked_in_chains(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(r.sample(links, len(links)), "a string, b string"))
    expected = {(n, c[0], k) for c in chains for k, n in enumerate(c)}
    for c in rings:
        k = c.index(min(c))
        expected |= {(n, min(c), i) for i, n in enumerate(c[k:] + c[:k])}
    rows = list(map(tuple, found.collect()))
    assert set(rows) == expected and len(rows) == len(nodes)
    assert graph.ranked_in_chains(spark.createDataFrame([], "node string"), spark.createDataFrame([], "a string, b string")).count() == 0


def plain_unitigs(kmers):
    """Ways that do not branch, extended letter by letter."""
    def after(k):
        return [k[1:] + b for b in "ACGT" if k[1:] + b in kmers]

    def before(k):
        return [b + k[:-1] for b in "ACGT" if b + k[:-1] in kmers]

    link = {k: n[0] for k in kmers if len(n := after(k)) == 1 and n[0] != k and before(n[0]) == [k]}
    back = {b: a for a, b in link.items()}
    seen, out = set(), set()
    for start in [k for k in sorted(kmers) if k not in back] + sorted(kmers):
        if start in seen:
            continue
        way, at = start, start
        seen.add(at)
        n = kmers[at]
        while at in link and link[at] not in seen:
            at = link[at]
            seen.add(at)
            way += at[-1]
            n += kmers[at]
        out.add((start, way, n))
    return out


@pytest.mark.parametrize("piece", [3, 10_000])
def test_unitigs(spark, piece):
    r = random.Random(5)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    shared = dna(40)
    texts = [dna(60) + shared + dna(30), dna(20) + shared + dna(50), "A" * 20, "ACGGT" * 9, dna(11), shared[5:30]]
    kmers = Counter(t[i : i + 9] for t in texts for i in range(len(t) - 8))
    rows = graph.unitigs(spark.createDataFrame(list(kmers.items()), "k string, c int"), "k", "c", piece).collect()
    ways = defaultdict(list)
    for x in rows:
        ways[x["head"]].append((x["part"], x["seq"], x["kmers"], x["support"]))
    found = {(h, "".join(s for _, s, _, _ in sorted(p)), sum(n for *_, n in p)) for h, p in ways.items()}
    assert found == plain_unitigs(kmers) and all(x["kmers"] <= piece for x in rows)


@pytest.mark.parametrize("seed", range(4))
def test_matches_in_file_order(spark, seed):
    r = random.Random(seed)
    truth = [(f"t{i}", i, r.choice("ab"), r.choice(["DEL", "INS"]), r.randint(0, 90), r.randint(1, 30)) for i in range(60)]
    found = [(f"c{i}", i, r.choice("ab"), r.choice(["DEL", "INS"]), r.randint(0, 90), r.randint(1, 30)) for i in range(80)]
    if seed == 3:  # all wait for one another
        truth, found = [(f"t{i}", i, "a", "INS", 10 * i, 1) for i in range(12)], [(f"c{i}", i, "a", "INS", 10 * i + 6, 1) for i in range(12)]
    frame = lambda rows, kind: spark.createDataFrame(rows, f"{kind}_id string, {kind}_order int, query_asm string, svtype string, pos long, svlen long").selectExpr("*", "'k' AS contig")
    used, expected = set(), set()
    for c, _, q, kind, pos, size in found:
        near = sorted((abs(pos - p), o, t) for t, o, tq, tk, p, n in truth if t not in used and (tq, tk) == (q, kind) and abs(pos - p) <= 7 and (kind == "INS" or abs(size - n) <= 7))
        if near:
            used.add(near[0][2])
            expected.add((near[0][2], c, near[0][0]))
    pairs = evaluation.within_window(frame(truth, "truth"), frame(found, "call"), 7)
    assert set(map(tuple, evaluation.file_order_matches(pairs).collect())) == expected


def plain_ancestral(q, r, kind):
    out, weights = "", []
    for i in range(max(len(q), len(r))):
        if i < len(q) and i < len(r):
            out += q[i] if q[i] == r[i] or kind == "DEL" else r[i]
            weights.append(0.995 if q[i] == r[i] else 0.65)
        elif i < len(r):
            out += r[i]
            weights.append(0.80)
        elif kind != "INS":
            out += q[i]
            weights.append(0.55)
    points = 2 if kind in ("TRA", "INV") else 1
    return out, min(len(q), len(r)), points, sum(weights) / len(weights) if weights else 0.0


def test_ancestral_bases(spark):
    r = random.Random(7)
    dna = lambda: "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 5, 40, 200])))
    rows = [(i, dna(), dna(), kind) for i, kind in enumerate(["INS", "DEL", "DUP", "INV", "TRA", "OFF_REF", "COMPLEX"] * 12)]
    rows += [(1000, "ACGT", "ACGA", "DUP"), (1001, "ACGTAC", "ACG", "DUP"), (1002, None, None, None), (1003, None, "AC", "DEL"), (1004, "AC", None, "INS")]
    found = {x["i"]: tuple(x)[1:] for x in calling.ancestral_rows(spark.createDataFrame(rows, "i long, q string, r string, t string"), "i", "q", "r", "t").collect()}
    for i, q, ref, kind in rows:
        *expected, mean = plain_ancestral(q or "", ref or "", kind)
        assert found[i][:3] == tuple(expected) and found[i][3] == pytest.approx(mean)
    assert found[1000][0] == "ACGA" and found[1001][3] == pytest.approx((3 * 0.995 + 3 * 0.55) / 6)


@pytest.mark.parametrize(("k", "letters"), [(9, 4_000_000), (9, 150), (15, 100), (3, 50)])
def test_unitigs_of_sequences(spark, monkeypatch, k, letters):
    monkeypatch.setattr(graph, "COUNTED_LETTERS", letters)
    monkeypatch.setattr(graph, "BUCKET_KMERS", 20)
    monkeypatch.setattr(graph, "ROW_KMERS", 3)
    r = random.Random(8)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    shared, ring = dna(40), dna(31)
    # a ring of 31 k-mers that nothing else meets, and one that has a tail
    texts = [dna(60) + shared + dna(30), dna(20) + shared + dna(50), "A" * 20, ring + ring[: k + 5], "ACGGT" * 9 + dna(30), dna(11), shared[5:30], "", None, dna(400), dna(9) + "N" + dna(20)]
    kmers = Counter(t[i : i + k] for t in texts if t for i in range(len(t) - k + 1) if "N" not in t[i : i + k])
    turning = {ring[i:] + ring[:i] for i in range(31)}
    expected = {w for w in plain_unitigs(kmers) if len(w[1]) > k and w[1][:31] not in turning}
    for piece in (4, 10_000):
        ways = defaultdict(list)
        for x in graph.unitigs_of_sequences(spark.createDataFrame([(t,) for t in texts], "seq string"), "seq", k, piece=piece).collect():
            ways[x["head"]].append((x["part"], x["seq"], x["kmers"], x["support"]))
        found = {(h, "".join(s for _, s, _, _ in sorted(p)), sum(n for *_, n in p)) for h, p in ways.items()}
        assert found == expected
        assert all(sum(n for _, _, n, _ in p) == len("".join(s for _, s, _, _ in p)) - k + 1 for p in ways.values())
