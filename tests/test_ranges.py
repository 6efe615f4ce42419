"""Sequences in ranges of bytes and as a stream, and files that many tasks write."""

import gzip
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from strandlake.sources import files, ranges
from strandlake.sources.stores import listed


def fastq(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = r.choice([1, 3, 40, 90, 400]) if r.random() < 0.95 else 0
        quality = "".join(r.choice("@+>IIFF#") for _ in range(size))
        out.append((f"r{i}", "".join(r.choice("ACGTN") for _ in range(size)), quality))
    return out


def text_of(rows, end="\n"):
    return "".join(f"@{n} note{end}{s}{end}+{n}{end}{q}{end}" for n, s, q in rows)


def fasta_of(rows, width=50):
    return "".join(f">{n} note\n" + "".join(s[k : k + width] + "\n" for k in range(0, len(s), width)) for n, s, _ in rows)


def of_ranges(path, most):
    parts = ranges.ranges(listed(str(path)), most)
    return [x for r in parts for x in ranges.records(r)], len(parts)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_cut_of_a_fastq_file_gives_the_same_reads(tmp_path, end):
    rows = fastq(1, 60)
    path = tmp_path / "a.fq"
    path.write_bytes(text_of(rows, end).encode())
    expected = [(n, s, q) for n, s, q in rows if s]
    whole, _ = of_ranges(path, 1 << 30)
    assert [x[:3] for x in whole] == expected and [x[3] for x in whole] == sorted({x[3] for x in whole})
    size = path.stat().st_size
    for most in [*range(1, 120), 500, 1000, size - 1, size]:
        assert of_ranges(path, most)[0] == whole


def test_any_cut_of_a_fasta_file_gives_the_same_contigs(tmp_path):
    rows = fastq(2, 40)
    path = tmp_path / "a.fa"
    path.write_text("stray line\n\n" + fasta_of(rows) + ">last\nACGT\n\nAC")
    whole, _ = of_ranges(path, 1 << 30)
    assert [x[:2] for x in whole] == [(n, s) for n, s, _ in rows if s] + [("last", "ACGTAC")]
    for most in [*range(1, 130), 700, 4000]:
        assert of_ranges(path, most)[0] == whole


@pytest.mark.parametrize("kind", ["fastq", "fasta"])
def test_any_cut_of_block_gzip(tmp_path, kind, monkeypatch):
    monkeypatch.setattr(files, "BLOCK_BYTES", 700)
    rows = fastq(3, 200)
    text = text_of(rows) if kind == "fastq" else fasta_of(rows)
    path = tmp_path / "a.gz"
    path.write_bytes(files.bgzf(text.encode()) + files.LAST_BLOCK)
    assert gzip.decompress(path.read_bytes()).decode() == text
    whole, n = of_ranges(path, 1 << 30)
    assert n == 1 and [x[:2] for x in whole] == [(n, s) for n, s, _ in rows if s]
    for most in (1, 17, 100, 299, 350, 1000, 5000):
        found, n = of_ranges(path, most)
        assert found == whole and n == -(-path.stat().st_size // most)


def test_members_of_plain_gzip_are_one_range(tmp_path):
    rows = fastq(4, 50)
    path = tmp_path / "a.fq.gz"
    path.write_bytes(gzip.compress(text_of(rows[:20]).encode()) + gzip.compress(text_of(rows[20:]).encode()))
    found, n = of_ranges(path, 100)
    assert n == 1 and [x[:3] for x in found] == [(n, s, q) for n, s, q in rows if s]
    path.write_bytes(path.read_bytes()[:-30])
    with pytest.raises(OSError):
        of_ranges(path, 100)


def test_sixteen_tasks_read_what_one_does(spark, tmp_path):
    rows = fastq(5, 3000)
    (tmp_path / "x.fq").write_text(text_of(rows))
    (tmp_path / "y.fa").write_text(fasta_of(rows[:10]))
    (tmp_path / "z.fq").write_text("")
    (tmp_path / "_hidden").write_text("@a\nC\n+\nI\n")
    size = (tmp_path / "x.fq").stat().st_size
    one, many = (ranges.read_ranges(spark, str(tmp_path / "x.fq"), most) for most in (1 << 30, -(-size // 16)))
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 16
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == sum(bool(s) for _, s, _ in rows)
    every = ranges.read_ranges(spark, f"file://{tmp_path}")
    assert {r["source"] for r in every.select("source").distinct().collect()} == {"x.fq", "y.fa"}
    assert ranges.read_ranges(spark, f"{tmp_path}/none*").count() == 0


def test_filters_reach_the_reader(spark, tmp_path):
    rows = fastq(6, 400)
    (tmp_path / "x.fq").write_text(text_of(rows))
    (tmp_path / "y.fq").write_bytes(b"@broken\nACGT\n+\nIIII\n")
    frame = ranges.read_ranges(spark, str(tmp_path), 2000)
    asked = frame.filter("source = 'x.fq' AND length >= 90 AND length < 400 AND contig LIKE 'r1%' AND quality LIKE '%#%'")
    expected = {n for n, s, q in rows if 90 <= len(s) < 400 and n.startswith("r1") and "#" in q}
    assert {r["contig"] for r in asked.collect()} == expected and expected
    plan = asked._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("Filter") : plan.index("Scan")] if "Filter" in plan else ""
    assert "length" not in left and "source" not in left and "quality" in left  # only what the reader doesn't know is asked again
    assert frame.filter("contig IN ('r3', 'broken')").count() == 1 + any(n == "r3" and s for n, s, _ in rows)


def test_a_stream_reads_each_file_once(spark, tmp_path):
    folder, log, sink, state = (tmp_path / n for n in ("in", "log", "out", "state"))
    folder.mkdir()

    def run():
        frame = ranges.stream_ranges(spark, str(folder), str(log), 300)
        job = frame.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        job.awaitTermination()
        return sorted((r["source"], r["contig"]) for r in spark.read.schema(frame.schema).parquet(str(sink)).collect())

    first, second = fastq(7, 50), fastq(8, 30)
    (folder / "b.fq").write_text(text_of(first))
    one = [("b.fq", n) for n, s, _ in first if s]
    assert run() == sorted(one) and run() == sorted(one)
    (folder / "a.fa").write_text(fasta_of(second))  # an earlier name arrives later
    (folder / "c.fq").write_text(text_of(second))
    both = one + [(x, n) for x in ("a.fa", "c.fq") for n, s, _ in second if s]
    assert run() == sorted(both) and run() == sorted(both)
    assert len(list(log.glob("entry-*.json"))) == 2


def test_a_stream_that_breaks_off_reads_the_same_batch_again(spark, tmp_path):
    folder, log, sink, state = (tmp_path / n for n in ("in", "log", "out", "state"))
    folder.mkdir()
    rows = fastq(9, 40)
    (folder / "a.fq").write_text(text_of(rows))
    broken = []

    def run(put):
        frame = ranges.stream_ranges(spark, str(folder), str(log), 500)
        job = frame.writeStream.foreachBatch(put).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        job.awaitTermination()

    def fails(batch, epoch):
        broken.append((epoch, batch.count()))
        raise RuntimeError("in the middle")

    with pytest.raises(Exception, match="in the middle"):
        run(fails)
    (folder / "b.fq").write_text(text_of(fastq(10, 10)))  # arrives between failure and restart
    for _ in range(2):  # what had begun is done again first
        run(lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/{epoch}"))
    found = spark.read.parquet(f"{sink}/*").collect()
    assert [r for r in broken] == [(0, sum(bool(s) for _, s, _ in rows))]
    assert sorted(r["contig"] for r in found if r["epoch"] == 0) == sorted(n for n, s, _ in rows if s)
    assert sorted(r["contig"] for r in found if r["epoch"] == 1) == sorted(n for n, s, _ in fastq(10, 10) if s)


def test_one_file_of_many_tasks(spark, tmp_path):
    path = str(tmp_path / "out.txt")
    rows = spark.range(5000).select(F.format_string("%05d é", "id").alias("value"))
    files.write_file(rows.repartitionByRange(7, "value").sortWithinPartitions("value"), path, "#one\n#two")
    expected = "#one\n#two\n" + "".join(f"{i:05} é\n" for i in range(5000))
    assert Path(path).read_text() == expected and files.verified(path)
    stated = files.manifest(spark, path).collect()
    assert sum(r["lines"] for r in stated) == 5000 and stated[0]["file_crc32"] == zlib.crc32(expected.encode()) and len(stated) == 7
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out.txt", "out.txt.manifest.json"]
    files.write_file(rows.filter("id < 3").coalesce(1), path, "#new", "bgzf")  # replaces it
    assert gzip.decompress(Path(path).read_bytes()).decode() == "#new\n00000 é\n00001 é\n00002 é\n" and files.verified(path)
    assert [x[:2] for x in of_ranges(path, 40)[0]] == []
    with open(path, "ab") as f:
        f.write(b"x")
    assert not files.verified(path)
    files.write_file(rows.limit(0), path)
    assert Path(path).read_text() == ""


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out.txt"
    path.write_text("as it was")
    rows = spark.range(400).repartition(4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("no line"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="no line"):
        files.write_file(rows, str(path))
    assert [p.name for p in tmp_path.iterdir()] == ["out.txt"] and path.read_text() == "as it was"


def test_a_part_that_changes_is_an_error(tmp_path):
    writer = files._Writer({"path": str(tmp_path / "o"), "header": "h"}, True)
    (tmp_path / "p").write_text("abc\n")
    with pytest.raises(OSError, match="in place of"):
        writer.commit([files.Part(0, str(tmp_path / "p"), 1, 4, 1)])
    assert [p.name for p in tmp_path.iterdir()] == ["p"]
    writer.commit([None, files.Part(0, str(tmp_path / "p"), 1, 4, zlib.crc32(b"abc\n"))])
    assert (tmp_path / "o").read_text() == "h\nabc\n"
    with pytest.raises(FileExistsError):
        files._Writer({"path": str(tmp_path / "o")}, False)
