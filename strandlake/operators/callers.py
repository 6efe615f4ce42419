"""Callers composed of routing, chains and fallbacks, and what follows them in read modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import scores as S
from strandlake.operators import calling
from strandlake.operators.selection import collapse, top_per_key

CALLS = ["query", "reference", "svtype", "pos", "end", "ref_pos", "ref_end", "svlen", "score", "anchors", "gq", "mode"]


def overlap_k(mode: Column, length: Column) -> Column:
    """The k of overlaps by mode and length."""
    return F.when(mode == "long", F.when(length >= 2000, 11).otherwise(13)).when(mode == "short", F.when(length >= 800, 13).otherwise(17)).otherwise(16)


def selected_references(near: DataFrame, per_assembly: int = 3, most: int | None = 256) -> DataFrame:
    """References of each query by containment: up to three of each assembly first, ``most`` in all (None: all)."""
    from strandlake.operators.selection import reserved_then_rank

    return reserved_then_rank(near, ["query"], "assembly", [F.col("containment").desc(), F.col("reference")], per_assembly, 2**31 - 1 if most is None else most)


def hierarchical(pairs: DataFrame, params: calling.CallParams = calling.CallParams()) -> DataFrame:
    """Chains first; for queries without any, the difference of lengths; for those without either, the novelty tier.

    pairs: query, reference, q_seq, r_seq, overlap. Each step works on what the one before left (anti joins by query).
    """
    chained = calling.call_rows(pairs, ["query", "reference"], "q_seq", "r_seq", params).select(*CALLS)
    sized = pairs.select("query", "reference", F.length("q_seq").alias("q"), F.length("r_seq").alias("r"), "overlap")
    left = sized.join(chained.select("query").distinct(), "query", "left_anti")
    nearest = top_per_key(left.filter("overlap >= 0.20"), ["query"], [F.abs(F.col("q") - F.col("r")), F.col("overlap").desc(), F.col("reference")])
    delta = nearest.withColumn("c", calling.length_delta_call(F.col("q"), F.col("r"), params.min_sv)).filter("c IS NOT NULL")
    nothing = lambda kind: F.lit(None).cast(kind)
    lengths = delta.select("query", "reference", "c.svtype", F.col("c.pos").cast("long").alias("pos"), (F.col("c.pos") + F.col("c.svlen")).cast("long").alias("end"), nothing("long").alias("ref_pos"), nothing("long").alias("ref_end"), F.col("c.svlen").cast("long").alias("svlen"), "c.score", F.lit(0).alias("anchors"), "c.gq", F.lit("length_delta").alias("mode"))
    rest = left.join(delta.select("query"), "query", "left_anti").groupBy("query").agg(F.max("overlap").alias("overlap"), F.max("q").alias("q"))
    novel = rest.withColumn("c", calling.off_reference_call(F.col("q"), F.col("overlap"))).filter("c IS NOT NULL")
    off = novel.select("query", nothing("string").alias("reference"), "c.svtype", "c.pos", F.col("q").cast("long").alias("end"), nothing("long").alias("ref_pos"), nothing("long").alias("ref_end"), "c.svlen", "c.score", F.lit(0).alias("anchors"), "c.gq", F.lit("off_reference").alias("mode"))
    return chained.withColumn("reference", F.col("reference").cast("string")).unionByName(lengths.withColumn("reference", F.col("reference").cast("string"))).unionByName(off)


def multi_rank(calls: DataFrame, ranks: list[str]) -> DataFrame:
    """Calls of passes over several ranks: of one place, type, size and reference the best score stays, the first rank on a tie."""
    order = F.struct(F.col("score"), (-F.array_position(F.array(*map(F.lit, ranks)), F.col("rank"))).alias("r"), "gq")
    keyed = calls.withColumn("_size", F.floor(F.abs("svlen") / 100))
    return collapse(keyed, ["query", "pos", "svtype", "_size", "reference"], order).drop("_size")


def read_mode_dedup(calls: DataFrame) -> DataFrame:
    """The call with most support of each bucket of place and size."""
    place = F.floor(F.coalesce("ref_pos", "pos") / 25)
    key = F.when(F.col("svtype") == "OFF_REF", F.concat_ws(":", "svtype", "annotation", "query", F.floor(F.col("pos") / 25))).otherwise(F.concat_ws(":", "svtype", "reference", place, F.greatest(F.lit(1), F.floor(F.abs("svlen") / 50))))
    support = F.col("score") + 2 * F.col("anchors") + 0.001 * F.abs("svlen") + F.when(F.col("annotation") != "NOVEL_WEAK", 5.0).otherwise(0.0)
    return collapse(calls.withColumn("_key", key).withColumn("_support", support), ["_key"], F.struct("_support", "gq", (-F.col("pos")).alias("p"))).drop("_key", "_support")


def low_coverage_filter(calls: DataFrame, tier: str) -> DataFrame:
    """At low coverage, drops rearrangements with little behind them."""
    weak = F.col("svtype").isin("INV", "DUP", "TRA") & (F.col("mode") == "single_ref") & (F.col("anchors") < 3)
    return calls.filter(~weak) if tier == "LOW" else calls


def dominant_only(calls: DataFrame) -> DataFrame:
    """Drops fallback calls whose score is under a quarter of their query's best."""
    best = calls.groupBy("query").agg(F.max("score").alias("_best"))
    return calls.join(best, "query").filter(~(F.col("mode").isin("length_delta", "kmer_fallback", "off_reference") & (4 * F.col("score") < F.col("_best")))).drop("_best")


def fragments(query: Column, reference: Column, least: int = 1000) -> Column:
    """Whether a read only covers a part of its reference."""
    return (query < least) | (query < 0.55 * reference)


def fused(calls: DataFrame, evidence: DataFrame, prior: float) -> DataFrame:
    """Posterior of each call from its layers of evidence (query, pos, layer, depth, alt, ref, mapq, bp, span)."""
    weight = S.evidence_weight(*[F.col(c) for c in ("layer", "depth", "alt", "ref", "mapq", "bp", "span")])
    sums = evidence.groupBy("query", "pos").agg(F.sum(weight).alias("_w"), F.count_distinct("layer").alias("fused_layers"), F.sum("depth").alias("fused_effective_depth"))
    odds = S.logit(F.lit(prior)) + F.coalesce(F.col("_w"), F.lit(0.0))
    return calls.join(sums, ["query", "pos"], "left").withColumn("fused_logodds_alt", odds).withColumn("fused_posterior_alt", S.sigmoid(odds)).drop("_w")
