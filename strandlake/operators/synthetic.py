"""Generated genomes with planted variants and their truth: for tests and benchmarks where nothing else has ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequence as Q

#: Bases that one digest gives.
DIGEST = 32
#: Planted kinds in turn, and their sizes.
PLANTED = {"INS": 320, "DEL": 320, "INV": 480, "DUP": 256}


def bases(name: Column, length: int) -> Column:
    """Bases that look random and depend on nothing but the name: two bits of each digit of digests."""
    blocks = F.transform(F.sequence(F.lit(1), F.lit(-(-length // DIGEST))), lambda i: F.md5(F.concat_ws("/", name, i)))
    return F.substring(F.translate(F.array_join(blocks, ""), "0123456789abcdef", "ACGT" * 4), 1, length)


def genomes(spark: SparkSession, n: int, length: int, seed: int = 1) -> DataFrame:
    """genome, reference: n reference sequences."""
    return spark.range(n).select(F.col("id").alias("genome"), bases(F.concat_ws("-", F.lit(seed), "id"), length).alias("reference"))


def planted(references: DataFrame, at: int) -> DataFrame:
    """genome, reference, query, svtype, svlen: each genome gets one event behind its base ``at``, the kinds in turn."""
    kinds = list(PLANTED)
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("genome") % len(kinds)).cast("int"))
    size = F.get(F.array(*[F.lit(PLANTED[k]) for k in kinds]), (F.col("genome") % len(kinds)).cast("int"))
    ref = F.col("reference")
    head, piece, tail = F.substring(ref, 1, at), F.substring(ref, F.lit(at + 1), F.col("svlen")), F.substring(ref, F.lit(at + 1) + F.col("svlen"), F.length(ref))
    new = F.substring(bases(F.concat_ws("-", F.lit("new"), "genome"), max(PLANTED.values())), F.lit(1), F.col("svlen"))
    rest = F.substring(ref, F.lit(at + 1), F.length(ref))
    query = F.when(F.col("svtype") == "INS", F.concat(head, new, rest)).when(F.col("svtype") == "DEL", F.concat(head, tail)).when(F.col("svtype") == "INV", F.concat(head, Q.reverse_complement(piece), tail)).otherwise(F.concat(head, piece, rest))
    return references.withColumn("svtype", kind).withColumn("svlen", size).withColumn("query", query)


def reads(rows: DataFrame, name: str, seq: str, length: int, step: int) -> DataFrame:
    """name, start, read: reads of one length that begin every ``step`` bases, every other one from the other strand."""
    cut = rows.select(name, F.explode(Q.windows(F.col(seq), length, step)).alias("w")).select(name, "w.start", "w.window")
    return cut.select(name, "start", F.when(F.floor(F.col("start") / step) % 2 == 1, Q.reverse_complement(F.col("window"))).otherwise(F.col("window")).alias("read"))
