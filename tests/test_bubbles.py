"""Bubbles of any length against a plain walk along each path."""

import random

import pytest
from pyspark.sql import functions as F
from strandlake.operators import graph

from tests.measured import shuffled

TURN = str.maketrans("ACGT", "TGCA")


def plain(clades, least=40, most=1_000_000, k=15):
    """clades: {name: {path: (contig, [segments])}}; the calls as a set of rows."""
    out = set()
    for clade, paths in clades.items():
        ref = min(paths, key=lambda p: (-sum(map(len, paths[p][1])), p))
        nodes = paths[ref][1]
        at, homes = {}, {}
        for i, s in enumerate(nodes):
            at.setdefault(s, []).append(i)
        for contig, segments in paths.values():
            for s in segments:
                homes.setdefault(s, set()).add(contig)
        words = {s[i : i + k] for s in nodes for i in range(len(s) - k + 1)}
        found = {}
        for path in sorted(paths):
            if path == ref:
                continue
            contig, segments = paths[path]
            last, held = -1, []

            def emit(start, end):
                alt, allele = "".join(held), "".join(nodes[start + 1 : end])
                if 0 < max(len(alt), len(allele)) and least <= max(len(alt), len(allele)) <= most:
                    found.setdefault((start, end, alt), (allele, tuple(sorted({c for s in held for c in homes[s]} - {contig})), []))[2].append(path)

            for s in segments:
                if s not in at:
                    held.append(s)
                    continue
                to = min(at[s], key=lambda x: abs(x - last - 1))
                if held or to > last + 1 or to <= last:
                    emit(last, last + 1 if to <= last else to)
                    held = []
                last = to
            if held:
                emit(last, len(nodes))
        for (start, end, alt), (ref_seq, partners, names) in found.items():
            n, m = len(ref_seq), len(alt)
            own = {alt[i : i + k] for i in range(m - k + 1)}
            share = len(own & words) / len(own) if m >= 100 and own else 1.0
            kind = "TRA" if partners else "INV" if n and n == m and alt[::-1].translate(TURN) == ref_seq else "DUP" if n and alt.startswith(2 * ref_seq) else "INS" if m > n else "DEL" if m < n else "COMPLEX"
            out.add((clade, start, end, kind, n, m, m - n, share < 0.05, round(share, 9), partners, tuple(names)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bubbles(spark, seed):
    r = random.Random(seed)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    clades = {}
    for c in ("x", "y", "z"):
        core = [dna(r.choice([30, 60, 120])) for _ in range(14)]
        core[9] = core[3]  # a node with two places
        paths = {"a::1": ("1", [*core, dna(900)])}
        for p in range(10):
            own, at = list(core), r.randint(1, 11)
            change = r.choice(["ins", "del", "inv", "dup", "new", "back", "far", "two", "same", "none", "move"])
            if change == "ins":
                own[at:at] = [dna(50) for _ in range(r.randint(1, 3))]
            elif change == "del":
                del own[at : at + r.randint(1, 3)]
            elif change == "inv":
                own[at] = own[at][::-1].translate(TURN)
            elif change == "dup":
                own[at] = own[at] * 2 + "A" * r.choice([0, 3])
            elif change == "new":
                own[at] = dna(len(own[at]))
            elif change == "back":
                own[at:at] = own[max(0, at - 3) : at]
            elif change == "far":
                own = own[:at] + [dna(200)]
            elif change == "two":
                own[at : at + 2] = [core[at + 1], core[at]]
            elif change == "same":
                own = [dna(45), *own]
            elif change == "none":
                own = [dna(80) for _ in range(4)]
            elif change == "move":
                paths["m::2"] = ("2", [foreign := dna(70), dna(30)])
                own[at:at] = [foreign]
            paths[f"b{p}::1"] = ("1", own)
            if p % 3 == 0:
                paths[f"c{p}::1"] = ("1", list(own))
        clades[c] = paths
    clades["one"] = {"only::1": ("1", [dna(100)])}
    rows = [(c, p, contig, i, s) for c, paths in clades.items() for p, (contig, segments) in paths.items() for i, s in enumerate(segments)]
    frame = spark.createDataFrame(rows, "clade string, path string, contig string, pos int, seg string").repartition(3)
    found = [(x["clade"], x["ref_start"], x["ref_end"], x["svtype"], x["ref_len"], x["alt_len"], x["svlen"], x["off_ref"], round(x["overlap"], 9), tuple(x["partners"]), tuple(x["paths"])) for x in graph.bubble_calls(frame, "clade", "path", "contig", "pos", "seg").collect()]
    assert len(found) == len(set(found)) and set(found) == plain(clades)
    assert graph.bubble_calls(frame.limit(0), "clade", "path", "contig", "pos", "seg").count() == 0


def test_shards_and_rows_in_any_order(spark, monkeypatch):
    """A clade of many steps is walked in shards, and steps may come in any order; nodes that occur often are one look-up."""
    r = random.Random(7)
    monkeypatch.setattr(graph, "PACKED_STEPS", 3)
    monkeypatch.setattr(graph, "WALKED_STEPS", 40)
    pool = ["".join(r.choice("ACGT") for _ in range(r.randint(1, 45))) for _ in range(12)]
    clades = {f"k{c}": {f"p{p:02}": ("one" if c else f"c{p % 3}", [r.choice(pool) for _ in range(r.randint(1, 25))]) for p in range(r.randint(1, 30))} for c in range(3)}
    ends = ["A" * 20, "C" * 20, "G" * 400]
    clades["twice"] = {p: ("one", [ends[0], s, *ends[1 : 3 if p == "a" else 2]]) for p, s in {"a": "ACGTT" * 9, "b": "ACGTT" * 18, "c": "AGGTT" * 18, "d": "AACGT" * 9}.items()}
    rows = [(c, p, contig, i, s) for c, paths in clades.items() for p, (contig, segments) in paths.items() for i, s in enumerate(segments)]
    frame = spark.createDataFrame(r.sample(rows, len(rows)), "clade string, path string, contig string, pos int, seg string")
    found = [(x["clade"], x["ref_start"], x["ref_end"], x["svtype"], x["ref_len"], x["alt_len"], x["svlen"], x["off_ref"], round(x["overlap"], 9), tuple(x["partners"]), tuple(x["paths"])) for x in graph.bubble_calls(frame, "clade", "path", "contig", "pos", "seg").collect()]
    expected = plain(clades)
    assert {"INS", "DUP", "DEL", "TRA", "INV"} <= {x[3] for x in expected}
    assert set(found) == expected and len(found) == len(expected)


def test_little_more_than_the_letters_is_written(spark):
    """Steps are written and shuffled many to a row: a row of a step costs several times its letters."""
    letters = 20 * 400 * 100 * 6
    frame = spark.range(20 * 400).selectExpr("id % 20 AS clade", "id AS path", "posexplode(transform(sequence(1, 100), i -> substr(md5(concat(id, '-', i)), 1, 6))) AS (pos, seg)").withColumn("contig", F.lit("c"))
    with shuffled(spark) as total:
        graph.bubble_calls(frame, "clade", "path", "contig", "pos", "seg", with_allele=True).drop("overlap", "off_ref").write.format("noop").mode("overwrite").save()
    assert 0 < total[0] < 4 * letters
