"""Panel tables: aggregates behind reports and manuscripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import scores as S
from strandlake.operators.selection import top_per_key

#: The order of phyla in panels.
PHYLA = ("Glomeromycota", "Basidiomycota", "Ascomycota")


def phylum_order(phylum: Column) -> Column:
    out = F.lit(len(PHYLA))
    for i, name in enumerate(PHYLA):
        out = F.when(phylum == name, i).otherwise(out)
    return out


def layer_rows(layers: DataFrame, samples: DataFrame) -> DataFrame:
    """Of each sample the first row that is its own, else the one of ALL."""
    own = samples.select(F.col("query_asm").alias("sample"))
    both = layers.withColumn("_keys", F.when(F.col("query_asm") == "ALL", F.lit(None)).otherwise(F.col("query_asm")))
    direct = own.join(both.filter("_keys IS NOT NULL"), F.col("sample") == F.col("_keys"))
    shared = own.join(F.broadcast(both.filter("_keys IS NULL").limit(1)), F.lit(True)).join(direct.select("sample"), "sample", "left_anti")
    return direct.drop("_keys").unionByName(shared.drop("_keys"))


def sample_table(calls: DataFrame, scores: DataFrame) -> DataFrame:
    """One row a sample and one for the panel: calls, types, off-reference share, and the best F1 of each type family."""
    counts = calls.rollup("query_asm").agg(F.count("*").alias("calls"), *[F.count_if(F.col("svtype") == k).alias(k.lower()) for k in ("INS", "DEL", "INV", "DUP", "TRA", "OFF_REF")])
    best = scores.rollup("query_asm").agg(F.max(F.when(F.col("svtype").isin("INS", "DEL"), F.col("f1"))).alias("indel_f1"), F.max(F.when(F.col("svtype").isin("INV", "DUP", "TRA"), F.col("f1"))).alias("rearrangement_f1"))
    name = F.coalesce("query_asm", F.lit("PANEL"))
    return counts.withColumn("query_asm", name).join(best.withColumn("query_asm", name), "query_asm", "left").withColumn("off_ref_share", S.ratio(F.col("off_ref"), F.col("calls")))


def method_table(rows: DataFrame) -> DataFrame:
    """Methods side by side: samples, median and total calls, validated share."""
    return rows.groupBy("method").agg(F.count_distinct("query_asm").alias("samples"), F.percentile("pred_calls", F.lit(0.5)).alias("median_calls"), F.sum("pred_calls").alias("total_calls"), S.ratio(F.sum("tp"), F.sum("pred_calls")).alias("rate"))


def caller_pivot(rows: DataFrame, callers: list[str]) -> DataFrame:
    """Counts of each sample by caller, and the consensus."""
    wide = rows.groupBy("query_asm").pivot("method", callers).agg(F.max("pred_calls"))
    return wide.join(rows.groupBy("query_asm").agg(F.max("tp").alias("consensus_tp")), "query_asm").na.fill(0)


def novelty_summary(calls: DataFrame) -> DataFrame:
    """Metrics of novelty with their share, one a row: pangenome-only calls and element groups."""
    only = ~F.coalesce("single_reference", F.lit(False))
    sums = calls.agg(F.count("*").alias("all_calls"), F.count_if(only).alias("pangenome_only"), *[F.count_if(F.coalesce(F.col("element") == k, F.lit(False))).alias(k) for k in ("HGT", "RIP", "STARSHIP")], F.count_if(F.coalesce(F.col("element").startswith("TE"), F.lit(False))).alias("TE"))
    names = ["pangenome_only", "HGT", "RIP", "STARSHIP", "TE"]
    long = sums.select("all_calls", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*", "all_calls")
    return long.select("metric", "n", F.round(S.ratio(100 * F.col("n"), F.col("all_calls")), 1).alias("percent"))


def novelty_metrics(calls: DataFrame, layers: DataFrame, followup: DataFrame) -> DataFrame:
    """(metric, value, percent): the twelve numbers of a novelty report, the first six as shares of all calls.

    calls: single_reference, read_supported, element_class; layers: query_asm and the columns of a layer table, of which the row of ALL counts (else the first by name); followup: one row a candidate.
    What the layers do not have is 0.
    """
    group = S.element_group(F.col("element_class"))
    alone = ~F.coalesce("single_reference", F.lit(False))
    counts = calls.agg(
        F.count("*").alias("novel_calls"), F.count_if(alone).alias("pangenome_only_calls"), F.count_if(~alone).alias("single_reference_equivalent_calls"), F.count_if(F.coalesce("read_supported", F.lit(False))).alias("read_supported_calls"),
        F.count_if(group == "HGT / Starship").alias("hgt_or_starship_candidate_calls"), F.count_if(group.isin("RIP / genome defense", "TE / repeat")).alias("te_or_two_speed_candidate_calls"),
    )
    have = lambda c: F.coalesce(F.get("_l", F.lit(0))[c].cast("double"), F.lit(0.0)) if c in layers.columns else F.lit(0.0)
    first = layers.agg(F.array_compact(F.array(F.min_by(F.struct(*layers.columns), F.struct(F.col("query_asm") != "ALL", F.col("query_asm"))))).alias("_l"))
    loci = have("deduplicated_pangenome_loci")
    of_layers = {"raw_pairwise_pangenome_observations": have("raw_pairwise_pangenome_observations"), "deduplicated_pangenome_loci": loci, "pangenome_powered_loci": loci, "pangenome_only_read_supported_loci": have("pangenome_only_read_supported"), "single_ref_fraction_of_raw": have("single_ref_fraction_of_raw")}
    one = counts.join(F.broadcast(first), F.lit(True)).join(F.broadcast(followup.agg(F.count("*").alias("followup_candidates"))), F.lit(True))  # a row each
    rows = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.round(S.ratio(100 * F.col(c), F.col("novel_calls")), 1).alias("percent")) for c in counts.columns]
    rows += [F.struct(F.lit(c).alias("metric"), v.alias("value"), F.lit(None).cast("double").alias("percent")) for c, v in [*of_layers.items(), ("followup_candidates", F.col("followup_candidates").cast("double"))]]
    return one.select(F.inline(F.array(*rows)))


def top_labels(rows: DataFrame, keys: list[str], label: str, n: int) -> DataFrame:
    """The n most frequent labels of each key as 'label:count;...', ties by name."""
    counts = rows.filter(S.masked(F.col(label)).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    best = top_per_key(counts, keys, [F.col("_n").desc(), F.col(label)], n, "_k")
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.concat_ws(":", label, "_n").alias("t")))), lambda x: x["t"]), ";").alias("top"))


def guild_summary(rows: DataFrame) -> DataFrame:
    """Candidates of each guild: counts, shards, priority, kinds, and the most frequent classes."""
    base = rows.groupBy("guild").agg(F.count("*").alias("candidates"), F.count_distinct("shard").alias("shards"), F.round(F.avg("priority"), 4).alias("mean_priority"), F.count_if(F.col("class").startswith("hgt")).alias("hgt"), F.count_if(F.col("class").contains("te_")).alias("te"), F.count_if(F.col("class").contains("switch")).alias("switch"), F.count_if(F.coalesce(F.col("supported"), F.lit(False))).alias("supported"))
    return base.join(top_labels(rows, ["guild"], "class", 4).withColumnRenamed("top", "top_classes"), "guild", "left")


def reannotation(rows: DataFrame) -> DataFrame:
    """Classes of each genome and of the panel."""
    return rows.rollup("element", "query_asm").agg(F.count("*").alias("n")).filter("element IS NOT NULL").withColumn("query_asm", F.coalesce("query_asm", F.lit("PANEL")))


def registry_diagnosis(manifest: DataFrame, lines: DataFrame) -> DataFrame:
    """One row on a manifest: entries, missing paths, carriage returns, and a verdict."""
    damaged = lines.agg(F.count_if(F.col("value").contains("\r")).alias("carriage_returns"))
    counts = manifest.agg(F.count("*").alias("entries"), F.count_if(F.coalesce(F.col("fasta_path"), F.lit("")) == "").alias("without_path"), F.count_distinct("clade_name").alias("clades"))
    verdict = F.when(F.col("entries") == 0, "empty").when((F.col("carriage_returns") > 0) | (F.col("without_path") > 0), "check").otherwise("ok")
    return counts.join(F.broadcast(damaged), F.lit(True)).withColumn("verdict", verdict)


def planned_volume(target: int, events_per_genome: int, genomes: int, length: int) -> tuple[int, int]:
    """Genomes and length that reach a number of events: more genomes first, up to four times, then longer ones."""
    need = -(-target // max(1, events_per_genome))
    use = min(max(genomes, need), 4 * genomes)
    return use, length if need <= use else -(-length * need // use)
