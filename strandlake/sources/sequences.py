"""FASTA and FASTQ as data sources, and their writers."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.functions import sequence as Q

SCHEMA = "source string, contig string, seq string, ordinal long"


def _lines(path: str) -> Iterator[str]:
    with open(path, "rb") as raw:
        zipped = raw.read(2) == b"\x1f\x8b"
    with gzip.open(path, "rt") if zipped else open(path) as f:
        for line in f:
            yield line.rstrip("\r\n")


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(name up to the first blank, sequence) of FASTA or four-line FASTQ; empty sequences are left out."""
    name, parts, first = None, [], True
    lines = iter(lines)
    for line in lines:
        if first and line.startswith("@"):
            while line:
                seq = next(lines, "")
                next(lines, ""), next(lines, "")
                if seq:
                    yield (line[1:].split() or [""])[0], seq
                line = next(lines, "")
            return
        first = False
        if line.startswith(">"):
            if name is not None and parts:
                yield name, "".join(parts)
            name, parts = (line[1:].split() or [""])[0], []
        elif name is not None:
            parts.append(line.strip())
    if name is not None and parts:
        yield name, "".join(parts)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source = os.path.basename(partition.value)
        for ordinal, (name, seq) in enumerate(records(_lines(partition.value))):
            yield source, name, seq, ordinal


class SequenceSource(DataSource):
    """``spark.read.format("strandlake-seq").load(glob)``: one partition for each file, gzip or plain, mounted on every node."""

    @classmethod
    def name(cls) -> str:
        return "strandlake-seq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(sorted(glob(self.options["path"])))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ files of a mounted folder, by the data source."""
    spark.dataSource.register(SequenceSource)
    return spark.read.format("strandlake-seq").load(path)


def read_fasta_text(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files of any store that Spark reads: whole files, split at their headers, inside the JVM."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), r"^.*/", "").alias("source"), "value")
    rows = files.select("source", F.posexplode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("ordinal", "record")).filter("ordinal > 0")
    name = F.regexp_extract("record", r"^(\S*)", 1)
    seq = F.regexp_replace(F.regexp_replace("record", r"^[^\n]*", ""), r"\s", "")
    return rows.select("source", name.alias("contig"), seq.alias("seq"), (F.col("ordinal") - 1).cast("long").alias("ordinal")).filter("seq != ''")


def read_fasta_split(spark: SparkSession, path: str) -> DataFrame:
    """source, contig, seq of plain FASTA files of any store, large files in parts: a record ends where a line begins with '>'."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.col("_metadata.file_path"), r"^.*/", "").alias("source"), F.regexp_replace("value", "^>", "").alias("record"))
    seq = F.regexp_replace(F.regexp_replace("record", r"^[^\n]*", ""), r"\s", "")
    return rows.select("source", F.regexp_extract("record", r"^(\S*)", 1).alias("contig"), seq.alias("seq")).filter("seq != ''")


def read_loaded(rows: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Sanitised reads within a length band; of repeated names of a source the last stays."""
    clean = rows.withColumn("seq", Q.sanitized(F.col("seq"))).filter(F.length("seq") >= least)
    clean = clean.filter(F.length("seq") <= most) if most else clean
    return clean.groupBy("source", "contig").agg(F.max_by("seq", "ordinal").alias("seq"), F.max("ordinal").alias("ordinal"))


def write_fasta(rows: DataFrame, path: str, width: int = 80) -> None:
    """contig and seq as FASTA text files."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), "contig", F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """One path a line; blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path != '' AND NOT startswith(path, '#')")
