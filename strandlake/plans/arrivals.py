"""Queries of sources and sinks that take part in files: ranges, streams, single files; and of streams with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequence as Q
from strandlake.plans.calling import _HITS, _hits
from strandlake.plans.documents import _SEQ_CTE, sequences
from strandlake.plans.registry import Tables, query
from strandlake.session import scratch_path
from strandlake.sources import files, ranges, tables
from strandlake.sources import sequences as fasta
from strandlake.sources.stores import listed, moved
from strandlake.streaming import incremental, state


@query(f"WITH {_SEQ_CTE} SELECT doc_id::VARCHAR AS contig, length(seq)::BIGINT AS length, md5(seq) AS digest, md5(repeat('I', length(seq))) AS quality FROM s WHERE length(seq) >= 100")
def fastq_in_ranges(t: Tables) -> DataFrame:
    """All sequences as reads of one FASTQ file in block gzip, written by many tasks and read in ranges of bytes; the reader itself leaves out short ones."""
    path = f"{scratch_path(t.spark, 'fastq')}/reads.fq.gz"
    rows = sequences(t).filter("seq != ''").select(F.col("doc_id").cast("string").alias("contig"), "seq", F.expr("repeat('I', length(seq))").alias("quality"))
    files.write_file(rows.select(ranges.fastq_lines("contig", "seq", "quality")), path, compression="bgzf")
    found = ranges.read_ranges(t.spark, path, 256 << 10).filter("length >= 100")
    return found.select("contig", "length", F.md5("seq").alias("digest"), F.md5("quality").alias("quality"))


@query(f"WITH {_SEQ_CTE} SELECT doc_id::VARCHAR AS contig, length(seq)::BIGINT AS n, md5(seq) AS digest, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS batch FROM s WHERE seq <> ''")
def sequences_as_they_arrive(t: Tables) -> DataFrame:
    """A stream of FASTA files that is stopped, goes on when more have arrived, and has nothing to do the third time: each record comes once, in its batch."""
    path = scratch_path(t.spark, "arrivals")
    rows = sequences(t).filter("seq != ''").select(F.col("doc_id").cast("string").alias("contig"), "seq", (F.col("doc_id") % 2).alias("half"))
    for half in (0, 1, None):
        if half is not None:
            fasta.write_fasta(rows.filter(F.col("half") == half).select("contig", "seq"), f"{path}/in-{half}")
            for name, _ in listed(f"{path}/in-{half}"):
                moved(name, f"{path}/in/{half}-{name.rsplit('/', 1)[-1]}")
        found = ranges.stream_ranges(t.spark, f"{path}/in", f"{path}/log", 256 << 10)
        out = incremental.finished(found, "arrivals", "append", f"{path}/out")
    batch = F.regexp_extract(F.input_file_name(), r"epoch=(\d+)", 1).cast("long")
    return out.select("contig", F.col("length").alias("n"), F.md5("seq").alias("digest"), batch.alias("batch"))


@query(
    f"""WITH {_HITS} SELECT type AS svtype, count(*) AS n, sum(CASE type WHEN 'DEL' THEN -svlen ELSE svlen END)::BIGINT AS svlen_sum, (SELECT count(*) FROM h) AS lines, true AS whole FROM h GROUP BY type"""
)
def vcf_in_one_file(t: Tables) -> DataFrame:
    """All calls as one sorted VCF file behind one header, read again; the manifest has as many lines as there are calls, and parts as long as the file."""
    path = f"{scratch_path(t.spark, 'vcf-file')}/calls.vcf"
    tables.write_vcf_file(_hits(t), path)
    stated = files.manifest(t.spark, path).groupBy("file_bytes", "file_lines").agg(F.sum("lines").alias("_l"), F.sum("bytes").alias("_b"))
    header = F.lit(len("\n".join(tables.vcf_header(["SAMPLE"])).encode()) + 1)
    checked = stated.select(F.col("file_lines").alias("lines"), ((F.col("_l") == F.col("file_lines")) & (F.col("_b") + header == F.col("file_bytes"))).alias("whole"))
    found = tables.read_vcf(t.spark, path).groupBy("svtype").agg(F.count("*").alias("n"), F.sum("svlen").alias("svlen_sum"))
    return found.join(F.broadcast(checked), F.lit(True))  # one row


_GAP, _LATE = 1800, 600


@query(
    f"""WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {_GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
    e AS (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY user_id, island) AS first, max(epoch_us(ts)) OVER (PARTITION BY user_id, island) + {_GAP}000000 AS stop FROM s)
    SELECT user_id, event_id, round(value, 4) AS value, first // 1000000 AS session_start, stop // 1000000 AS session_end FROM e WHERE stop <= (SELECT max(epoch_ms(ts)) - {_LATE}000 FROM events) * 1000"""
)
def contigs_fallen_silent(t: Tables) -> DataFrame:
    """Rows of each contig of a stream, given out when it has been silent for half an hour by event time; what is still open is not."""
    rows = state.file_stream(t.spark, t.sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    out = incremental.finished(state.silent(rows, "user_id", "ts", f"{_GAP} seconds", f"{_LATE} seconds"), "silent", "append")
    return out.select("user_id", "event_id", F.round("value", 4).alias("value"), F.unix_timestamp("session_start").alias("session_start"), F.unix_timestamp("session_end").alias("session_end"))


@query(
    f"""WITH {_SEQ_CTE}, k AS (SELECT DISTINCT lang, substr(md5(substr(seq, i, 16)), 1, 15) AS h FROM (SELECT lang, seq, unnest(range(1, length(seq) - 14)) AS i FROM s))
    SELECT lang, h FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= 64"""
)
def sketch_in_state(t: Tables) -> DataFrame:
    """The 64 smallest k-mer hashes of each clade, kept as state while documents arrive."""
    rows = state.file_stream(t.spark, t.sf_dir, "documents").select("lang", Q.dna_projection(F.col("text")).alias("seq"))
    own = F.transform(F.array_distinct(Q.kmers(F.col("seq"), 16)), lambda k: F.substring(F.md5(k), 1, 15))
    hashes = rows.select("lang", F.explode(F.slice(F.array_sort(F.array_distinct(own)), 1, 64)).alias("h"))  # of a document, its own smallest ones are enough
    return state.sketches(state.smallest(hashes, "lang", "h", 64), 64, "sketch-state").select(F.col("key").alias("lang"), F.explode("values").alias("h"))
