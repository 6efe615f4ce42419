"""Routing, callers and panel tables on small literals."""

from pyspark.sql import functions as F
from strandlake.operators import callers, panels, routing


def test_catalog(spark):
    manifest = spark.createDataFrame([("A", "P", "C", "x/a.fa", "g1"), ("B", "P", ".", "x/b.fa", "g2")], "asm string, phylum string, class string, fasta_path string, clade_name string")
    seqs = spark.createDataFrame([("a.fa", "c1", "GGCC"), ("a.fa", "c__sv_1", "AA"), ("b.fa", "c2", "ATGC")], "source string, contig string, seq string")
    assert {(r["asm"], r["contig"], r["gc"]) for r in routing.load_catalog(manifest, seqs).collect()} == {("A", "c1", 1.0), ("B", "c2", 0.5)}
    only = routing.load_catalog(manifest, seqs, manifest.filter("asm = 'B'"))
    assert [r["asm"] for r in only.collect()] == ["B"]
    assert {(r["rank"], r["clade"], r["genomes"]) for r in routing.shard_counts(manifest).collect()} == {("phylum", "P", 2), ("class", "C", 1)}
    assert routing.decoys(spark, 5, 3).count() == 15 and routing.without_decoys(routing.decoys(spark, 5, 3), "reference").count() == 0
    rows = spark.createDataFrame([("k", i) for i in range(50)], "k string, i long")
    assert routing.reservoir(rows, "k", "i", 7).count() == 7
    assert [r["i"] for r in routing.capped(rows, ["k"], F.lit(10), 35, [F.col("i")]).orderBy("i").collect()] == [0, 1, 2]


def test_best_by_clade(spark):
    near = spark.createDataFrame([("q", "a", 0.02), ("q", "b", 0.40)], "query string, reference string, containment double")
    clades = spark.createDataFrame([("a", "own"), ("b", "far")], "reference string, clade string")
    r = routing.best_by_clade(near, clades, spark.createDataFrame([("q", "own")], "query string, own string")).first()
    assert (r["same_overlap"], r["other_overlap"], r["tier"]) == (0.02, 0.40, "HGT_CROSS_CLADE")


def test_hierarchical(spark):
    import random

    r = random.Random(1)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    ref = dna(1200)
    pairs = [("chain", "r", ref[:500] + ref[620:], ref, 0.8), ("length", "r", dna(400), ref, 0.5), ("novel", "r", dna(600), ref, 0.0), ("same", "r", ref, ref, 1.0)]
    rows = callers.hierarchical(spark.createDataFrame(pairs, "query string, reference string, q_seq string, r_seq string, overlap double")).collect()
    assert {(x["query"], x["svtype"], x["mode"]) for x in rows} == {("chain", "DEL", "mem_chain"), ("length", "DEL", "length_delta"), ("novel", "OFF_REF", "off_reference")}


def test_read_mode(spark):
    schema = "query string, reference string, svtype string, pos long, ref_pos long, svlen long, score double, anchors int, gq double, annotation string, mode string"
    calls = spark.createDataFrame([("q1", "r", "DEL", 10, 100, 120, 5.0, 2, 20.0, "NONE", "mem_chain"), ("q2", "r", "DEL", 12, 101, 121, 9.0, 4, 30.0, "NONE", "mem_chain"), ("q1", "r", "INV", 500, 900, 60, 1.0, 1, 9.0, "NONE", "single_ref")], schema)
    kept = callers.read_mode_dedup(calls)
    assert {(x["query"], x["svtype"]) for x in kept.collect()} == {("q2", "DEL"), ("q1", "INV")}
    assert callers.low_coverage_filter(kept, "LOW").count() == 1 and callers.low_coverage_filter(kept, "HIGH").count() == 2


def test_panels(spark):
    rows = spark.createDataFrame([("INS", "HGT", False), ("DEL", "RIP", True)], "svtype string, element string, single_reference boolean")
    found = {r["metric"]: (r["n"], r["percent"]) for r in panels.novelty_summary(rows).collect()}
    assert found["pangenome_only"] == (1, 50.0) and found["HGT"] == (1, 50.0)
    layers = spark.createDataFrame([("ALL", 1), ("a", 2)], "query_asm string, n int")
    samples = spark.createDataFrame([("a",), ("b",)], "query_asm string")
    assert {(r["sample"], r["n"]) for r in panels.layer_rows(layers, samples).collect()} == {("a", 2), ("b", 1)}
    guilds = spark.createDataFrame([("g", "s1", "hgt_candidate", 6, True), ("g", "s2", "te_structural", 3, None)], "guild string, shard string, class string, priority int, supported boolean")
    r = panels.guild_summary(guilds).first()
    assert (r["candidates"], r["shards"], r["mean_priority"], r["hgt"], r["te"], r["supported"], r["top_classes"]) == (2, 2, 4.5, 1, 1, 1, "hgt_candidate:1;te_structural:1")
    assert panels.planned_volume(100, 10, 4, 50) == (10, 50) and panels.planned_volume(1000, 10, 4, 50) == (16, 313)
    lines = spark.createDataFrame([("a\r",)], "value string")
    manifest = spark.createDataFrame([("c", "p")], "clade_name string, fasta_path string")
    assert panels.registry_diagnosis(manifest, lines).first()["verdict"] == "check"
