"""Readers and writers, by writing and reading back."""

import gzip

from strandlake.sources import sequences, tables


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 note\nACGT\nacgt\n>empty\n>c2\nNNRY\r\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 x\nACGTT\n+\nIIIII\n@r2\nGG\n+\nII\n")
    rows = sequences.read_sequences(spark, f"{tmp_path}/*.*")
    assert sorted(tuple(r) for r in rows.collect()) == [("a.fa", "c1", "ACGTacgt", 0), ("a.fa", "c2", "NNRY", 1), ("b.fq.gz", "r1", "ACGTT", 0), ("b.fq.gz", "r2", "GG", 1)]
    text = sequences.read_fasta_text(spark, f"{tmp_path}/a.fa")
    assert sorted((r["contig"], r["seq"]) for r in text.collect()) == [("c1", "ACGTacgt"), ("c2", "NNRY")]
    loaded = sequences.read_loaded(rows, 4)
    assert {r["contig"]: r["seq"] for r in loaded.collect()} == {"c1": "ACGTACGT", "c2": "NNNN", "r1": "ACGTT"}
    sequences.write_fasta(loaded, f"{tmp_path}/out", 3)
    again = sequences.read_fasta_text(spark, f"{tmp_path}/out/part-*")
    assert {r["contig"]: r["seq"] for r in again.collect()} == {r["contig"]: r["seq"] for r in loaded.collect()}


def test_manifests(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("#asm\tphylum\nA\tP\tC\tO\tF\tG\tclade\tgenus\ta.fa\nB\tP\tclade2\tspecies\tb.fa\r\n")
    rows = {r["asm"]: r for r in tables.read_manifest(spark, f"{tmp_path}/m.tsv").collect()}
    assert rows["A"]["genus"] == "G" and rows["B"]["genus"] is None and rows["B"]["fasta_path"] == "b.fa"
    (tmp_path / "r.tsv").write_text("\t".join(tables.ROUTING) + "\nx\tgenus\tP\ta\tb\tc\td\t3\t4\t5\t1,zz,7\n")
    r = tables.read_routing(spark, f"{tmp_path}/r.tsv").first()
    assert r["centroid_hashes"] == [1, 7] and r["nodes"] == 4
    (tmp_path / "list").write_text("a\n\n# c\n b \n")
    assert [x["path"] for x in sequences.read_path_list(spark, f"{tmp_path}/list").collect()] == ["a", "b"]


def test_intervals_and_genes(spark, tmp_path):
    (tmp_path / "x.gff").write_text("##gff\nc\ts\tgene\t5\t9\t.\t+\t.\tID=1\n")
    (tmp_path / "x.bed").write_text("c\t4\t9\n")
    (tmp_path / "x.b6").write_text("c\tr\t99\t5\t0\t0\t9\t5\t1\t5\t0\t50\n")
    for name, kind in (("gff", "gff3"), ("bed", "bed"), ("b6", "blast6")):
        assert [tuple(r) for r in tables.read_intervals(spark, f"{tmp_path}/x.{name}", kind).collect()] == [("c", 5, 9)]
    (tmp_path / "g.tsv").write_text("contig\tgene_id\tstart\tend\nc\tG\t9\t3\n")
    assert tuple(tables.read_genes(spark, f"{tmp_path}/g.tsv").first()) == (".", "c", "G", "G", 3, 9)
    (tmp_path / "e.tsv").write_text("sample\tasm\tgene_id\ttpm\tcondition\ns\ta\tG\t-2\tx\n")
    assert tables.read_expression(spark, f"{tmp_path}/e.tsv").first()["expression"] == 0.0


def test_validation_report(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1)], "clade_name string, genome_count long")
    b = spark.createDataFrame([("x",), ("x",), ("z",)], "clade_name string")
    assert {r["clade_name"]: r["status"] for r in tables.validation_report(a, b).collect()} == {"x": "ok", "y": "check", "z": "check"}
    assert tables.summary_json(a, "clade_name", "genome_count").first()[0] == '{"x":2,"y":1}'


def test_streams(spark, sf):
    from strandlake.streaming import incremental

    events = incremental.stream(spark, sf, "events")
    found = incremental.finished(incremental.deduplicated(events, ["event_id"]).select("event_id"), "dedup", "append")
    assert found.count() == found.distinct().count() == 1000
