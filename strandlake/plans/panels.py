"""Queries of panel tables and rank-wise shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import callers, panels, routing, sketch
from strandlake.plans.calls import _CALLS, _TAXONOMY, calls, taxonomy
from strandlake.plans.documents import sequences
from strandlake.plans.registry import Tables, query


@query(
    f"""WITH {_TAXONOMY}, r AS (SELECT 'phylum' AS rank, phylum AS clade, sample FROM tax UNION ALL SELECT 'class', clade, sample FROM tax) SELECT rank, clade, count(DISTINCT sample) AS genomes FROM r GROUP BY ALL"""
)
def rank_shards(t: Tables) -> DataFrame:
    """Genomes of each shard of a catalog split by rank."""
    manifest = taxonomy(t).select(F.col("phylum"), F.col("clade").alias("class"), F.col("sample").cast("string").alias("fasta_path"))
    return routing.shard_counts(manifest)


@query(
    f"""WITH {_CALLS}, {_TAXONOMY} SELECT coalesce(query_asm, 'PANEL') AS query_asm, count(*) AS calls, count(*) FILTER (WHERE svtype = 'INS') AS ins, count(*) FILTER (WHERE svtype = 'DEL') AS del, count(*) FILTER (WHERE svtype = 'INV') AS inv
    FROM (SELECT 'asm' || sample AS query_asm, svtype FROM calls) GROUP BY ROLLUP (query_asm)"""
)
def panel_samples(t: Tables) -> DataFrame:
    """Calls of each sample and of the panel by type."""
    rows = calls(t).groupBy(F.concat(F.lit("asm"), "sample").alias("query_asm"), "svtype").agg(F.count("*").alias("n"))
    scores = rows.select("query_asm", "svtype", F.lit(1.0).alias("f1"))
    table = panels.sample_table(rows.withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("query_asm", "svtype"), scores)
    return table.select("query_asm", "calls", "ins", "del", "inv")


@query(
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM c)
    SELECT p_brand AS brand, string_agg(p_type || ':' || n, ';' ORDER BY k) AS top FROM k WHERE k <= 3 GROUP BY p_brand"""
)
def top_labels_by_brand(t: Tables) -> DataFrame:
    """The three most frequent types of each brand."""
    return panels.top_labels(t.part.select(F.col("p_brand").alias("brand"), "p_type"), ["brand"], "p_type", 3)


@query(
    f"""WITH {_CALLS}, e AS (SELECT tax >= 0.04 AS single, CASE WHEN discount >= 0.08 THEN 'HGT' WHEN discount >= 0.06 THEN 'RIP' WHEN discount >= 0.03 THEN 'TE_LTR' ELSE 'NONE' END AS element FROM calls),
    s AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT single) AS a, count(*) FILTER (WHERE element = 'HGT') AS b, count(*) FILTER (WHERE element = 'RIP') AS c, count(*) FILTER (WHERE element LIKE 'TE%') AS d FROM e)
    SELECT metric, k AS n, round(100 * k / n, 1) AS percent FROM s, LATERAL (VALUES ('pangenome_only', a), ('HGT', b), ('RIP', c), ('STARSHIP', 0), ('TE', d)) AS v(metric, k)"""
)
def novelty_table(t: Tables) -> DataFrame:
    """Novelty metrics and their shares."""
    element = F.when(F.col("discount") >= 0.08, "HGT").when(F.col("discount") >= 0.06, "RIP").when(F.col("discount") >= 0.03, "TE_LTR").otherwise("NONE")
    return panels.novelty_summary(calls(t).select((F.col("tax") >= 0.04).alias("single_reference"), element.alias("element")))


@query(
    f"""WITH {_CALLS}, c AS (SELECT part, pos, tax >= 0.04 AS single, line % 2 = 0 AS supported, CASE WHEN discount >= 0.08 THEN ' hgt' WHEN discount >= 0.06 THEN 'RIP' WHEN discount >= 0.03 THEN 'TE_LTR' WHEN discount >= 0.02 THEN '.' END AS element FROM calls),
    s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE NOT single)::DOUBLE AS a, count(*) FILTER (WHERE single)::DOUBLE AS b, count(*) FILTER (WHERE supported)::DOUBLE AS c, count(*) FILTER (WHERE element = ' hgt')::DOUBLE AS d, count(*) FILTER (WHERE element IN ('RIP', 'TE_LTR'))::DOUBLE AS e,
      count(DISTINCT (part, pos))::DOUBLE AS loci, count(DISTINCT (part, pos)) FILTER (WHERE NOT single AND supported)::DOUBLE AS alone, avg(CASE WHEN single THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) FILTER (WHERE supported AND NOT single)::DOUBLE AS f FROM c)
    SELECT metric, round(k, 9) AS value, CASE WHEN p THEN round(100 * k / n, 1) END AS percent FROM s, LATERAL (VALUES ('novel_calls', n, true), ('pangenome_only_calls', a, true), ('single_reference_equivalent_calls', b, true), ('read_supported_calls', c, true), ('hgt_or_starship_candidate_calls', d, true),
      ('te_or_two_speed_candidate_calls', e, true), ('raw_pairwise_pangenome_observations', n, false), ('deduplicated_pangenome_loci', loci, false), ('pangenome_powered_loci', loci, false), ('pangenome_only_read_supported_loci', alone, false), ('single_ref_fraction_of_raw', share, false), ('followup_candidates', f, false)) AS v(metric, k, p)"""
)
def novelty_report(t: Tables) -> DataFrame:
    """All twelve numbers of a novelty report: calls, their layers in all, and what is to be followed up."""
    element = F.when(F.col("discount") >= 0.08, " hgt").when(F.col("discount") >= 0.06, "RIP").when(F.col("discount") >= 0.03, "TE_LTR").when(F.col("discount") >= 0.02, ".")
    rows = calls(t).select("part", "pos", (F.col("tax") >= 0.04).alias("single_reference"), (F.col("line") % 2 == 0).alias("read_supported"), element.alias("element_class"))
    alone = ~F.col("single_reference") & F.col("read_supported")
    layers = rows.agg(F.count("*").alias("raw_pairwise_pangenome_observations"), F.count_distinct("part", "pos").alias("deduplicated_pangenome_loci"), F.count_distinct(F.when(alone, F.struct("part", "pos"))).alias("pangenome_only_read_supported"), F.avg(F.col("single_reference").cast("double")).alias("single_ref_fraction_of_raw"))
    found = panels.novelty_metrics(rows, layers.withColumn("query_asm", F.lit("ALL")), rows.filter(alone))
    return found.withColumn("value", F.round("value", 9))


@query()
def cross_clade_overlaps(t: Tables) -> DataFrame:
    """Every hundredth document against documents of its own and of other clades: best overlaps and tiers (parts tested by themselves)."""
    p = sketch.postings(sequences(t), "doc_id", "seq", 16, "0")
    named = sequences(t).withColumn("_id", F.struct("doc_id", "lang"))
    every = sketch.postings(named, "_id", "seq", 16, "0").select(F.col("_id.doc_id").alias("reference"), F.col("_id.lang").alias("_lang"), "h")
    # the best of every clade, the largest of equal ones, are all that the best of two groups of clades can be
    near = sketch.best_pairs(p.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "h"), every, 1, "containment", part="_lang", last=True, drop_self=True).drop("_lang")
    clades = t.documents.select(F.col("doc_id").alias("reference"), F.col("lang").alias("clade"))
    own = t.documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("lang").alias("own"))
    return routing.best_by_clade(near, clades, own)


@query()
def hierarchical_calls(t: Tables) -> DataFrame:
    """Every hundredth document called against its nearest ones: chains, then lengths, then novelty (kernels tested on planted events)."""
    p = sketch.postings(sequences(t), "doc_id", "seq", 16, "0")
    queries = sequences(t).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("seq").alias("q_seq"))
    near = sketch.route_topk(p.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "h"), p.select(F.col("doc_id").alias("reference"), "h"), 2)
    references = sequences(t).select(F.col("doc_id").alias("reference"), F.col("seq").alias("r_seq"))
    pairs = queries.join(near.join(references, "reference"), "query", "left").select("query", "reference", "q_seq", F.coalesce("r_seq", F.lit("")).alias("r_seq"), F.coalesce("jaccard", F.lit(0.0)).alias("overlap"))
    return callers.hierarchical(pairs)
