"""Catalogs of reference sequences, decoys, rank-wise shards, and routing across clades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import scores as S
from strandlake.functions import sequence as Q
from strandlake.operators import sketch
from strandlake.operators.selection import top_per_key

#: Ranks from the root down, and the prefixes of decoys.
RANKS = ("phylum", "class", "order", "family", "genus", "species")
DECOYS = ("decoy_clade_", "DecoyPhylum_")


def load_catalog(manifest: DataFrame, sequences: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """One row for each sequence of each manifest entry, with GC; injected contigs are left out, and files outside ``allowed`` if given."""
    listed = manifest.withColumn("source", F.regexp_replace("fasta_path", r"^.*/", ""))
    if allowed is not None:
        listed = listed.join(allowed.select("fasta_path").distinct(), "fasta_path", "left_semi")
    rows = listed.join(sequences, "source").filter(~F.col("contig").contains("__sv_"))
    return rows.withColumn("gc", Q.gc_content(F.col("seq"))).dropDuplicates(["fasta_path", "contig", "clade_name"])


def capped(rows: DataFrame, keys: list[str], size: Column, cap: int, order: list[Column]) -> DataFrame:
    """Rows of each key in order until their summed size passes ``cap`` (the first row always stays)."""
    from pyspark.sql import Window

    running = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", running).filter((F.col("_run") <= cap) | (F.col("_run") == size)).drop("_run")


def by_rank(manifest: DataFrame) -> DataFrame:
    """A row for each rank of each entry that is known: rank, clade, and the entry."""
    present = [r for r in RANKS if r in manifest.columns]
    ranks = F.array(*[F.struct(F.lit(r).alias("rank"), S.masked(F.col(r)).alias("clade")) for r in present])
    return manifest.withColumn("_r", F.explode(ranks)).select("_r.rank", "_r.clade", *manifest.columns).filter("clade IS NOT NULL")


def shard_counts(manifest: DataFrame) -> DataFrame:
    """Genomes of each shard (rank, clade)."""
    return by_rank(manifest).groupBy("rank", "clade").agg(F.count_distinct("fasta_path").alias("genomes"))


def decoys(spark, n: int, hashes: int, seed: int = 7) -> DataFrame:
    """n random centroids in posting form: reference, phylum, rank, h."""
    rows = spark.range(n).withColumn("reference", F.format_string("decoy_clade_%d", "id"))
    rows = rows.withColumn("phylum", F.format_string("DecoyPhylum_%d", F.col("id") % 16)).withColumn("rank", F.element_at(F.array(*map(F.lit, RANKS)), (F.col("id") % 6 + 1).cast("int")))
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(hashes)))).select("reference", "phylum", "rank", sketch.hash60(F.concat_ws("/", "id", "i", F.lit(seed))).alias("h"))


def without_decoys(rows: DataFrame, name: str) -> DataFrame:
    """Drops decoys; apply before the top-k, so that none takes a place."""
    keep = F.lit(True)
    for prefix in DECOYS:
        keep = keep & ~F.col(name).startswith(prefix)
    return rows.filter(keep)


def reservoir(rows: DataFrame, key: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """A stable sample of n rows of each key (a sampling operator)."""
    return top_per_key(rows, [key], [F.md5(F.concat_ws("/", F.lit(seed), row_id)), F.col(row_id)], n)


def best_by_clade(near: DataFrame, clades: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: best overlap with its own and with another clade, who has it, and the tier.

    near (query, reference, containment), clades (reference, clade), expected (query, own).
    """
    rows = near.join(clades, "reference").join(expected, "query")
    same = F.col("clade") == F.col("own")
    best = rows.groupBy("query").agg(
        F.coalesce(F.max(F.when(same, F.col("containment"))), F.lit(0.0)).alias("same_overlap"),
        F.coalesce(F.max(F.when(~same, F.col("containment"))), F.lit(0.0)).alias("other_overlap"),
        F.max_by("reference", F.when(~same, F.struct("containment", "reference"))).alias("other_reference"),
    )
    return best.withColumn("tier", S.cross_clade_tier(F.col("same_overlap"), F.col("other_overlap")))


def route_windows(sequences: DataFrame, name: str, seq: str, references: DataFrame, size: int, overlap: int, k: int = 16, top: int = 1) -> DataFrame:
    """Routes overlapping windows of each sequence by themselves: name, start, and the nearest references."""
    starts = sequences.select(name, seq, F.explode(Q.positional_windows(F.length(seq), size, overlap)).alias("start"))
    rows = starts.select(F.concat_ws(":", name, "start").alias("query"), F.substring(F.col(seq), F.col("start") + 1, F.lit(size)).alias("window"))
    return sketch.route_topk(sketch.postings(rows, "query", "window", k), references, top, False)
