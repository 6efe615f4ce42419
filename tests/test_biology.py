"""Evidence, element labels, ecology, findings, writers and streams that resume, by literals."""

import math

import pytest
from pyspark.sql import functions as F
from strandlake.functions import evidence as E
from strandlake.operators import biology, elements
from strandlake.sources import tables
from strandlake.streaming import incremental


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_observations(spark):
    names = "svtype string, mode string, query_mode string, anchors int, mapq double, gq double, score double, annotation string, mate_contig string, overlap double"
    rows = [
        ("DEL", "mem_chain", "assembly", 4, 30.0, 20.0, 50.0, "NONE", None, 0.5), ("OFF_REF", "off", "short", 0, 0.0, 20.0, 8.0, "NOVEL", None, 0.01), ("TRA", "x", "long", 1, 0.0, 0.0, 5.0, "NONE", "", 0.04),
        ("TRA", "mem_chain", "long", 3, 0.0, 0.0, 9.0, "NONE", "", 0.04), ("INV", "simple_length_fallback", "short", 2, 10.0, 5.0, 0.0, "NONE", None, 0.01),
    ]
    frame = spark.createDataFrame(rows, names)
    terms = E.observation({c: F.col(c) for c in frame.columns}, F.col("overlap"), F.lit(2.0), F.lit(0.1))
    found = frame.select(*[v.alias(k) for k, v in terms.items()]).collect()
    a, b, c, d, e = found
    assert (a["layer"], a["depth"], a["bp"], a["span"], a["ref"]) == ("ASM", 8.0, pytest.approx(0.57), 0.5, pytest.approx(0.85))
    assert a["alt"] == pytest.approx(math.log1p(50) + 0.72 + 0.9 + 0.6 + 1.25 + 0.45)
    assert (b["layer"], b["depth"], b["span"]) == ("SR", 0.25, pytest.approx(0.16)) and b["ref"] == pytest.approx(0.85 + 0.022) and b["alt"] == pytest.approx(math.log1p(8) + 0.6 + 0.025 + 0.6)
    assert c["ref"] == pytest.approx(0.85 + 0.75 + 5 + 1.2 + 2) and c["alt"] == pytest.approx(math.log1p(5) + 0.18 + 0.1 - 2.5 - 1)
    assert d["ref"] == pytest.approx(0.85) and d["bp"] == pytest.approx(0.24 + 0.25 + 0.1)
    assert e["ref"] == pytest.approx(0.85 + 1.5 + 0.75 + 5 + 1.8) and e["alt"] == pytest.approx(0.36 + 0.3 + 0.15 + 0.025 + 0.25 - 2.5)


def test_names_and_places(spark):
    call = lambda kind: {"svtype": F.lit(kind), "ref_contig": F.lit("c1"), "pos": F.lit(0), "end": F.lit(9), "mate_contig": F.lit("c2"), "mate_pos": F.lit(5), "mate_end": F.lit(3)}
    assert [value(spark, E.breakpoints(call(k))) for k in ("TRA", "INV", "OFF_REF", "INS")] == ["TRA:c1:1-9->c2:5-5", "INV:1-9", "OFF_REF:1-9", "INS:1-9"]
    assert value(spark, E.breakpoints(call("OFF_REF"), False)) == "."
    assert [value(spark, E.near_boundary(F.lit(p), 100, 5)) for p in (0, 4, 5, 95, 96, 150)] == [True, True, False, False, True, False]
    assert value(spark, E.plain_contig(F.lit("chr1_ins12__sv_del"))) == "chr1" and value(spark, E.path_safe(F.lit("a b/c"))) == "a_b_c"
    label = lambda h: tuple(value(spark, E.element_label(F.lit(h))))
    assert label(">te1#Class_II/TIR/hAT extra") == ("te1", "DNA", "TIR", "hAT", True) and label("te2#LTR/Copia") == ("te2", "LTR", "", "Copia", True)
    assert label("te3 some text") == ("te3", None, None, None, False) and label("te4#") == ("te4", None, None, None, False) and label("te5#MITE") == ("te5", "DNA", "", "MITE", True)
    pairs = {("", "A"): 0.0, ("AC", "AC"): 1.0, ("ACGT", "ACTT"): 3 / 5, ("AAAA", "AA"): 2 / 4, ("XABC", "YABC"): 3 / 4}
    frame = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    assert [r[0] for r in frame.select(E.end_similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx(list(pairs.values()))
    hashes = [3, 2**63 - 1, -5]
    sig, mask = 0x9E3779B97F4A7C15, 2**64 - 1
    for h in hashes:
        sig ^= ((h & mask) + 0x9E3779B97F4A7C15 + ((sig << 6) & mask) + (sig >> 2)) & mask
    sig ^= 3 * 0xBF58476D1CE4E5B9 & mask
    found = spark.createDataFrame([(hashes,), (None,)], "h array<long>").select(E.route_signature("h")).collect()
    assert found[0][0] & mask == sig and found[1][0] is None and E.centroid_signature(hashes, 4) != E.centroid_signature(hashes, 5)
    arrays = spark.createDataFrame([([1, 2], [3]), ([1, 65], [1]), ([], [1]), ([1], [65])], "a array<long>, b array<long>")
    assert [r[0] for r in arrays.select(E.may_share(F.col("a"), F.col("b"))).collect()] == [False, True, False, True]
    assert value(spark, E.letter_rank(F.lit("ACCA"), "A", F.lit(3))) == 1 and value(spark, E.has_letters(F.lit("ACG"), F.lit("CG"))) and not value(spark, E.has_letters(F.lit("ACG"), F.lit("CT")))


def test_elements(spark, tmp_path):
    import random

    r = random.Random(4)
    family = {k: "".join(r.choice("ACGT") for _ in range(600)) for k in ("LTR/Copia", "LTR/Gypsy", "Class_II/TIR/hAT")}
    changed = lambda s: "".join(c if r.random() > 0.02 else r.choice("ACGT") for c in s)
    train = [(f"t{i}#{k}", changed(s)) for i, (k, s) in enumerate(list(family.items()) * 3)] + [("free", "ACGT" * 50)]
    centroids = elements.train(spark.createDataFrame(train, "header string, seq string"), "header", "seq")
    assert {x[0] for x in centroids.select("centroid").distinct().collect()} == {"LTR/Copia", "LTR/Gypsy", "DNA/TIR/hAT"}
    elements.save(centroids, str(tmp_path / "model"))
    asked = [(f"q{i} x", changed(s)) for i, s in enumerate(family.values())] + [("far", "T" * 100)]
    found = elements.classify(spark.createDataFrame(asked, "header string, seq string"), "header", "seq", elements.load(spark, str(tmp_path / "model")))
    got = {x["id"]: (x["pred_class"], x["pred_order"], x["pred_superfamily"]) for x in found.collect()}
    assert got == {"q0": ("LTR", "", "Copia"), "q1": ("LTR", "", "Gypsy"), "q2": ("DNA", "TIR", "hAT"), "far": ("Unknown", "Unknown", "Unknown")}
    elements.write_predictions(found, str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("*.csv") for x in p.read_text().splitlines()]
    assert "id\tpred_class\tpred_order\tpred_superfamily\tjaccard_sim\tbest_centroid" in lines and "far\tUnknown\tUnknown\tUnknown\t0.0000\t." in lines


def test_ecology(spark, tmp_path):
    (tmp_path / "traits.tsv").write_text("query_asm\tprimary_lifestyle\tspecies\ng1.fa\tsaprotroph\tAspergillus niger\ng1.fa\tother\tx\n\tnobody\ty\n")
    traits = biology.read_traits(spark, str(tmp_path / "traits.tsv"))
    assert {x["alias"]: x["primary_lifestyle"] for x in traits.collect()} == {"g1.fa": "saprotroph", "g1": "saprotroph"}
    long = spark.createDataFrame([("Puccinia_graminis", None, "trophic_mode_fg", "Pathotroph"), ("Puccinia_graminis", None, "substrate", "wheat"), ("", "Boletus", "trophic_mode_fg", "Symbiotroph"), ("x y", None, "colour", "red")], "species string, genus string, trait_name string, value string")
    species, genus = biology.trait_table(long)
    meta = spark.createDataFrame(
        [("g1.fa", "A", None), ("g2", "Puccinia graminis", None), ("g3", "Boletus edulis", None), ("g4", "Glomus sp", "Glomus"), ("g5", "Pichia sp", "Pichia"), ("g6", "odd", None), ("g7", "Fusarium x", "Fusarium")], "query_asm string, species string, genus string"
    ).select("*", *[F.lit(None).cast("string").alias(c) for c in ("family", "order", "class", "phylum", "scenario", "lifestyle")])
    found = {x["query_asm"]: (x["ecological_trait"], x["trophic_mode"], x["substrate_or_host"], x["species"]) for x in biology.ecological_context(meta, traits, species, genus).collect()}
    assert found["g1.fa"] == ("saprotroph", "saprotroph", ".", "Aspergillus niger") and found["g2"] == ("Pathotroph", "Pathotroph", "wheat", "Puccinia graminis") and found["g3"][0] == "Symbiotroph"
    assert found["g4"][0] == "Symbiotroph_arbuscular_mycorrhizal" and found["g5"][0] == "Saprotroph_yeast" and found["g6"][0] == "." and found["g7"][0] == "Pathotroph_plant_pathogen"


def test_findings(spark):
    fields = "query_asm string, contig string, pos long, end long, svtype string, mate_contig string, mate_pos long"
    call = lambda pos, kind="DEL": ("q1", "ctg", pos, pos + 100, kind, None, None)
    candidates = spark.createDataFrame([call(110), call(5000), call(9000, "INS")], fields)
    from strandlake.operators.evaluation import locus_key

    locus = lambda rows: spark.createDataFrame(rows, fields).select(locus_key().alias("locus"))
    support = locus([call(5010)]).withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("a"))))
    found = {x["pos"]: (x["comparator_support_count"], x["single_reference_equivalent"], x["unique"], x["evidence_tier"]) for x in biology.findings(candidates, support, spark.createDataFrame([call(100)], fields), locus([call(9001, "INS")]).withColumn("tier", F.lit("strong"))).collect()}
    assert found == {110: (0, "yes", "no", "."), 5000: (2, "no", "no", "."), 9000: (0, "no", "yes", "strong")}
    rows = spark.createDataFrame([("assembly", "syri", "c1", "INS"), ("assembly", "syri", "c9", "OFF_REF")], "query_mode string, method string, contig string, svtype string")
    seen = {x["method"]: (x["present"], x["calls"], x["off_ref"], x["misrouted"]) for x in biology.comparators(rows, {"assembly": ["syri", "svim"]}, spark.createDataFrame([("c1",)], "contig string")).collect()}
    assert seen == {"syri": (True, 2, 1, 1), "svim": (False, 0, 0, 0)}
    assert biology.combined(candidates, candidates.limit(1), candidates.withColumn("more", F.lit(1))).count() == 6
    truth = spark.createDataFrame([(1, "s1"), (2, "s2")], "id long, species string")
    reps = spark.createDataFrame([("r1", "s1"), ("r2", "s2"), ("r3", "s3")], "reference string, species string")
    assert sorted((x["id"], x["reference"]) for x in biology.truth_of_others(truth, reps).collect()) == [(1, "r2"), (1, "r3"), (2, "r1"), (2, "r3")]
    with pytest.raises(ValueError):
        biology.truth_of_others(truth, reps, 2)
    given = spark.createDataFrame([(3, 9, 0.5, 1.0)], "start long, end long, precision double, recall double")
    same = biology.harmonised(given, {"pos": ["start"], "svlen": ["length"], "f1": ["F1"]}).first()
    assert (same["pos"], same["svlen"], round(same["f1"], 6)) == (3, 6, 0.666667)


def test_reads_and_orders(spark):
    reads = spark.createDataFrame([("a", f"r{i}", 1000 + i) for i in range(2000)] + [("b", "only", 10)], "k string, name string, n long")
    kept = biology.downsampled(reads, "k", "name", "n", F.col("_bases") / 10_000, 45.0)
    share = kept.filter("k = 'a'").count() / 2000
    assert abs(share - 45 / (sum(1000 + i for i in range(2000)) / 10_000)) < 0.04 and kept.filter("name IN ('r1999', 'only')").count() == 2
    rows = spark.createDataFrame([("x", 1, 2), ("x", 4, 3), ("x", 9, 5)], "k string, at long, w long")
    assert [tuple(r)[2:] for r in biology.order_statistics(rows, ["k"], "at", "w").orderBy("at").collect()] == [(2, None, 4, 2), (3, 1, 9, 5), (5, 4, None, 10)]
    assert [biology.kth(rows, ["k"], "at", "w", k).first()[1] for k in (1, 2, 3, 5, 6)] == [1, 1, 4, 4, 9]


HITS = "query_asm string, query_contig string, type string, ref_asm string, ref_contig string, pos long, end long, svlen long, genotype string, gq double, annotation string, query_mode string, mate_contig string, mate_pos long"


def test_vcf_declares_what_it_writes(spark, tmp_path):
    rows = [("q1", "c1", "DEL", "r", "rc", 10, 60, 50, "0/1", 30.0, "NONE", "assembly", None, None), ("q1", "c1", "TRA", "r", "rc", 90, 95, 5, "0/1", 9.0, "NONE", "assembly", "c7", 777), ("q2x", "c1", "OFF_REF", "r", "rc", 5, 9, 4, "1/1", 20.0, "NOVEL", "assembly", None, None)]
    calls = spark.createDataFrame(rows, HITS)
    tables.write_vcf(calls, str(tmp_path / "v"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()]
    declared = {x.split("ID=")[1].split(",")[0] for x in lines if x.startswith("##INFO")}
    used = {kv.split("=")[0] for x in lines if not x.startswith("#") for kv in x.split("\t")[7].split(";")}
    assert used <= declared and {"ANNOT", "REFCONTIG", "QASM", "QMODE", "CHR2", "POS2", "OFFREF"} <= used
    back = {r["svtype"]: r for r in tables.read_vcf(spark, str(tmp_path / "v")).collect()}
    assert back["TRA"]["alt"] == "N[c7:777[" and (back["TRA"]["mate_contig"], back["TRA"]["mate_pos"], back["TRA"]["filter"]) == ("c7", 777, "LowGQ") and back["DEL"]["svlen"] == -50
    (tmp_path / "bnd.vcf").write_text("c1\t5\t.\tN\t]c2:99]N\t.\tPASS\tSVTYPE=BND\nc1\t7\t.\tN\t[c3:8[N\t.\tPASS\tX\n")
    assert [(r["svtype"], r["mate_contig"], r["mate_pos"]) for r in tables.read_vcf(spark, str(tmp_path / "bnd.vcf")).orderBy("pos").collect()] == [("TRA", "c2", 99), ("TRA", "c3", 8)]
    many = [r["value"].split("\t") for r in tables.multisample_lines(calls, ["q1", "q2", "q3"]).orderBy("rank", "n", "pos").collect() if not r["value"].startswith("##")]
    assert many[0][9:] == ["q1", "q2", "q3"] and [m[9:] for m in many[1:]] == [["0/0", "1/1", "0/0"], ["0/1", "0/0", "0/0"], ["0/1", "0/0", "0/0"]]


def test_ancestral_table_and_artifacts(spark, tmp_path):
    rows = [("q1", "c1", "TRA", "r", "rc", 90, 95, 5, "0/1", 9.0, "NONE", "assembly", "c7", 777), ("q1", "c1", "DEL", "r2", "rc", 1, 60, -50, "0/1", 9.0, "NONE", "assembly", None, None)]
    calls = spark.createDataFrame(rows, HITS).withColumn("ancestral", F.when(F.col("type") == "DEL", "ACGT")).withColumn("aligned", F.lit(4)).withColumn("mean_posterior", F.lit(0.9)).withColumn("phylum", F.lit("P"))
    out = tables.ancestral_table(calls)
    assert tuple(out.columns) == tables.ANCESTRAL and len(out.columns) == 13
    got = {r["variant_type"]: (r["breakpoints"], r["segment_bp"], r["ancestral_seq"], r["clade_rank"], r["source_phylum"]) for r in out.collect()}
    assert got == {"TRA": ("TRA:rc:90-95->c7:777-777", 5, ".", ".", "P"), "DEL": ("DEL:1-60", 4, "ACGT", ".", "P")}
    tables.write_tsv(out, str(tmp_path / "anc"))
    folded = tables.read_ancestral(spark, str(tmp_path / "anc")).collect()
    assert len(folded) == 1 and folded[0]["clades"] == ["r", "r2"] and folded[0]["types"] == ["DEL", "TRA"] and folded[0]["recombined"] and folded[0]["mean_posterior"] == 0.9
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    tables.write_scores(spark.createDataFrame([(1.0,)], "f1 double"), spark.createDataFrame([(1, 2)], "truth_id long, call_id long"), ids, ids, str(tmp_path / "pr"))
    assert spark.read.csv(str(tmp_path / "pr" / "missed.tsv"), sep="\t", header=True).first()["id"] == "2" and spark.read.json(str(tmp_path / "pr" / "scores.json")).first()["f1"] == 1.0
    tables.write_store(spark.createDataFrame([("genus", "P", 1), ("order", "Q", 2)], "rank string, phylum string, n long"), str(tmp_path / "store"), "rank", "phylum")
    assert [r["n"] for r in tables.read_store(spark, str(tmp_path / "store"), rank="order").collect()] == [2]


def test_last_row_of_a_hit(spark, tmp_path):
    head = "\t".join(tables.HITS)
    row = lambda size: "\t".join({"query_contig": "c", "pos": "1", "end": "2", "type": "INS", "svlen": size}.get(c, ".") for c in tables.HITS)
    (tmp_path / "h.tsv").write_text("\n".join([head, row("7"), row("9"), row("8")]) + "\n")
    assert [r["svlen"] for r in tables.read_hits(spark, str(tmp_path / "h.tsv")).collect()] == [8]


def test_streams_resume(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda n, rows: spark.createDataFrame(rows, "k string, h long").coalesce(1).write.mode("append").parquet(str(folder / f"part{n}"))
    read = lambda: spark.readStream.schema("k string, h long").option("recursiveFileLookup", "true").parquet(str(folder))
    write(1, [("a", 5), ("a", 9), ("b", 1)])
    first = incremental.sketch_stream(read(), "k", 2, str(tmp_path / "state"))
    assert sorted(map(tuple, first.collect())) == [("a", 5), ("a", 9), ("b", 1)]
    write(2, [("a", 3), ("a", 5), ("c", 2)])
    again = incremental.sketch_stream(read(), "k", 2, str(tmp_path / "state"))  # a new query that goes on
    assert sorted(map(tuple, again.collect())) == [("a", 3), ("a", 5), ("b", 1), ("c", 2)]
    counts = lambda: incremental.finished(read(), "rows", "append", str(tmp_path / "rows")).count()
    assert counts() == 6
    write(3, [("d", 1)])
    assert counts() == 7
