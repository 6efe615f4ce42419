"""Queries that bind matching, evaluation, caller steps and panel tables to whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import evidence as E
from strandlake.functions import scores as S
from strandlake.operators import biology, callers, calling, evaluation, intervals, panels, selection
from strandlake.plans import reads  # noqa: F401  its SQL is used below
from strandlake.plans.calls import _CALLS, _TAXONOMY, calls, distinct_calls, taxonomy
from strandlake.plans.registry import ORACLE_SQL, Tables, query
from strandlake.session import scratch_path
from strandlake.sources import tables

#: Calls with the columns of evaluations. One row a call: contig and line are its key.
_EV = f"""{_CALLS}, ev AS (SELECT contig * 10 + line AS id, 'asm' || (sample % 7) AS query_asm, 'c' || (contig % 50) AS contig, pos, "end", CASE WHEN line = 7 THEN 'TRA' ELSE svtype END AS svtype, len AS svlen, part, tax >= 0.04 AS single_reference, line AS read_support, CASE WHEN line = 7 THEN 'c' || (part % 9) END AS mate_contig,
    CASE WHEN line = 7 THEN part END AS mate_pos, 'm' || (part % 3) AS method, discount, price, status FROM calls)"""
_GROUP = "CASE WHEN svtype IN ('INS', 'DUP', 'TANDEM_DUP') THEN 'INSDUP' ELSE svtype END"
_LOCUS = f"query_asm || '|' || contig || '|' || {_GROUP} || '|' || (pos // 500) || '|' || CASE WHEN svtype = 'TRA' THEN mate_contig || ':' || (mate_pos // 500) ELSE '' END"


def evaluated(t: Tables) -> DataFrame:
    moved = F.col("line") == 7
    return calls(t).select(
        (F.col("contig") * 10 + F.col("line")).alias("id"), F.concat(F.lit("asm"), F.col("sample") % 7).alias("query_asm"), F.concat(F.lit("c"), F.col("contig") % 50).alias("contig"), "pos", "end", F.when(moved, "TRA").otherwise(F.col("svtype")).alias("svtype"),
        F.col("len").alias("svlen"), "part", (F.col("tax") >= 0.04).alias("single_reference"), F.col("line").alias("read_support"), F.when(moved, F.concat(F.lit("c"), F.col("part") % 9)).alias("mate_contig"), F.when(moved, F.col("part")).alias("mate_pos"),
        F.concat(F.lit("m"), F.col("part") % 3).alias("method"), "discount", "price", "status",
    )


@query(
    f"""WITH {_EV}, l AS (SELECT query_asm, {_LOCUS} AS locus, count(*) AS raw, max(single_reference::INT) AS single, max(read_support) AS reads FROM ev GROUP BY ALL)
    SELECT query_asm, sum(raw)::BIGINT AS raw_pairwise_pangenome_observations, count(*) AS deduplicated_pangenome_loci, count(*) FILTER (WHERE single <> 0) AS single_reference_equivalent_calls, count(*) FILTER (WHERE single = 0) AS pangenome_only_calls,
      count(*) FILTER (WHERE single = 0 AND reads > 0) AS pangenome_only_read_supported FROM l GROUP BY query_asm"""
)
def call_layers(t: Tables) -> DataFrame:
    """Observations, loci and layers of each sample's calls."""
    return evaluation.call_layers(evaluated(t))


@query(
    f"""WITH {_EV}, g AS (SELECT *, contig || '|' || svtype || '|' || ((pos + 12) // 25) AS locus FROM ev)
    SELECT locus, (list(id ORDER BY read_support DESC, id))[1] AS id, count(DISTINCT id) AS n FROM g GROUP BY locus"""
)
def projected_loci(t: Tables) -> DataFrame:
    """Projected calls of one locus: the one with most read support, and how many there are."""
    rows = evaluation.projected_dedup(evaluated(t).select("id", "contig", "svtype", "pos", "read_support"))
    locus = F.concat_ws("|", "contig", "svtype", F.floor((F.col("pos") + 12) / 25).cast("string"))
    return rows.select(locus.alias("locus"), "id", F.size("ids").cast("long").alias("n"))


@query(
    f"""WITH {_EV}, v AS (SELECT query_asm, count(*) FILTER (WHERE method = 'm0' AND svtype = 'TRA') AS pred_calls, count(*) FILTER (WHERE method = 'm1') / 10.0 AS comparator_median FROM ev GROUP BY query_asm)
    SELECT query_asm, pred_calls, CASE WHEN pred_calls = 0 THEN 'fail' WHEN pred_calls / comparator_median < 0.2 THEN 'low' WHEN pred_calls / comparator_median > 5 THEN 'high' ELSE 'ok' END AS status FROM v"""
)
def volume_status(t: Tables) -> DataFrame:
    """Call volumes against comparators."""
    v = evaluated(t).groupBy("query_asm").agg(F.count_if((F.col("method") == "m0") & (F.col("svtype") == "TRA")).alias("pred_calls"), (F.count_if(F.col("method") == "m1") / 10.0).alias("comparator_median"))
    return evaluation.volume_audit(v).select("query_asm", "pred_calls", "status")


_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query(
    f"""WITH {_EV}, u AS (SELECT NOT single_reference AS u, svtype = 'TRA' AS f1, discount >= 0.08 AS f2 FROM ev), l AS (SELECT 'moved' AS feature, u, f1 AS has FROM u UNION ALL SELECT 'cheap', u, f2 FROM u),
    c AS (SELECT feature, count(*) FILTER (WHERE u AND has) AS a, count(*) FILTER (WHERE u AND NOT has) AS b, count(*) FILTER (WHERE NOT u AND has) AS c, count(*) FILTER (WHERE NOT u AND NOT has) AS d FROM l GROUP BY feature),
    p AS (SELECT feature, least(1, sum(exp({_CHOOSE.format('(a+b)', 'x')} + {_CHOOSE.format('(c+d)', '(a+c-x)')} - {_CHOOSE.format('(a+b+c+d)', '(a+c)')}))) AS p FROM (SELECT *, unnest(range(a, least(a + b, a + c) + 1)) AS x FROM c) GROUP BY feature)
    SELECT feature, a, b, c, d, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio, round(p, 4) AS p, round(least(1, 2 * p), 4) AS p_bonferroni FROM c JOIN p USING (feature)"""
)
def feature_enrichment(t: Tables) -> DataFrame:
    """Features among calls that only the pangenome has, against shared ones."""
    rows = evaluated(t).select((~F.col("single_reference")).alias("u"), (F.col("svtype") == "TRA").alias("moved"), (F.col("discount") >= 0.08).alias("cheap"))
    return evaluation.enrichment(rows, "u", ["moved", "cheap"]).select("feature", "a", "b", "c", "d", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("p", 4).alias("p"), F.round("p_bonferroni", 4).alias("p_bonferroni"))


@query(
    f"""WITH {_EV}, c AS (SELECT query_asm, count(*) FILTER (WHERE svtype = 'TRA' AND method = 'm0') AS tp, count(*) FILTER (WHERE method = 'm0') AS calls, count(*) FILTER (WHERE svtype = 'TRA') AS comparators, count(*) AS universe FROM ev GROUP BY query_asm),
    q AS (SELECT *, comparators / universe AS base, tp / calls AS precision FROM c), p AS (SELECT query_asm, least(1, sum(exp({_CHOOSE.format('calls', 'x')} + x * ln(base) + (calls - x) * ln(1 - base)))) AS p FROM (SELECT *, unnest(range(tp, calls + 1)) AS x FROM q) GROUP BY query_asm)
    SELECT query_asm, round(precision, 6) AS precision, round(tp / comparators, 6) AS recall, round(precision / base, 6) AS enrichment, round(p, 4) AS p, CASE WHEN base * calls < 1 THEN 'underpowered' WHEN p <= 0.05 AND precision / base > 1 THEN 'enriched' ELSE 'not enriched' END AS verdict FROM q JOIN p USING (query_asm)"""
)
def comparator_verdicts(t: Tables) -> DataFrame:
    """Precision, recall and enrichment against comparators, with a binomial test and a verdict."""
    hit, own = F.col("svtype") == "TRA", F.col("method") == "m0"
    counts = evaluated(t).groupBy("query_asm").agg(F.count_if(hit & own).alias("tp"), F.count_if(own).alias("calls"), F.count_if(hit).alias("comparators"), F.count("*").alias("universe"))
    return evaluation.comparator_scores(counts).select("query_asm", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("enrichment", 6).alias("enrichment"), F.round("p", 4).alias("p"), "verdict")


@query(
    f"""WITH {_EV}, r AS (SELECT CASE WHEN discount >= 0.08 THEN 'hgt_candidate' WHEN discount >= 0.06 THEN 'te_expression_link' WHEN discount >= 0.03 THEN 'te_structural' ELSE 'novel_sequence' END AS class, read_support AS priority FROM ev)
    SELECT CASE class WHEN 'hgt_candidate' THEN 'transfer' WHEN 'te_expression_link' THEN 'expression' WHEN 'te_structural' THEN 'mobile_element' ELSE 'structural' END AS bucket, count(*) AS n, max(priority) AS priority FROM r GROUP BY class"""
)
def followup_plan(t: Tables) -> DataFrame:
    """Validation buckets of candidates."""
    kind = F.when(F.col("discount") >= 0.08, "hgt_candidate").when(F.col("discount") >= 0.06, "te_expression_link").when(F.col("discount") >= 0.03, "te_structural").otherwise("novel_sequence")
    return evaluation.followup_buckets(evaluated(t).select(kind.alias("class"), F.col("read_support").alias("priority"))).select("bucket", "n", "priority")


@query(
    f"""WITH {_EV}, r AS (SELECT contig, discount AS padj, (floor(price)::BIGINT % 7) - 3 AS log2_fc, pos AS distance_bp, id AS gene_id FROM ev), o AS (SELECT *, padj <= 0.05 AND abs(log2_fc) >= 1 AS sig FROM r)
    SELECT contig, count(*) AS records, count(*) FILTER (WHERE sig) AS significant, (list(gene_id ORDER BY CASE WHEN sig THEN 0 ELSE 1 END, -abs(log2_fc), distance_bp, gene_id))[1] AS best_gene, bool_or(sig) AS supported FROM o GROUP BY contig"""
)
def expression_best(t: Tables) -> DataFrame:
    """Expression records of each candidate and the best of them."""
    rows = evaluated(t).select("contig", F.col("discount").alias("padj"), (F.floor("price") % 7 - 3).alias("log2_fc"), F.col("pos").alias("distance_bp"), F.col("id").alias("gene_id"))
    return evaluation.expression_summary(rows, ["contig"]).select("contig", "records", "significant", "best_gene", "supported")


@query(
    f"""WITH {_EV}, c AS (SELECT query_asm, contig, pos, "end", svtype, max((discount >= 0.05)::INT) AS yes FROM ev GROUP BY ALL), r AS (SELECT query_asm, count(*) AS total, sum(yes)::BIGINT AS yes FROM c GROUP BY query_asm),
    w AS (SELECT *, yes / total AS p FROM r)
    SELECT query_asm, total, yes, round(p, 6) AS rate, round(greatest(0, (p + 3.8416 / (2 * total) - 1.96 * sqrt(p * (1 - p) / total + 3.8416 / (4 * total * total))) / (1 + 3.8416 / total)), 6) AS lo, round(least(1, (p + 3.8416 / (2 * total) + 1.96 * sqrt(p * (1 - p) / total + 3.8416 / (4 * total * total))) / (1 + 3.8416 / total)), 6) AS hi FROM w"""
)
def validated_rates(t: Tables) -> DataFrame:
    """Validated calls of each sample, a call being validated if any of its sources says so."""
    rows = evaluated(t).select("query_asm", "contig", "pos", "end", "svtype", F.when(F.col("discount") >= 0.05, "yes").otherwise("no").alias("read_validated"))
    return evaluation.panel_rates(rows).select("query_asm", "total", "yes", *[F.round(c, 6).alias(c) for c in ("rate", "lo", "hi")])


@query(
    f"""WITH {_EV}, r AS (SELECT query_asm, method, svtype, read_support AS pred_calls, CASE WHEN part % 2 = 0 THEN 'query' ELSE 'ref' END AS space, CASE WHEN read_support = 5 THEN 'x_any_clade' END AS f FROM ev),
    k AS (SELECT *, max((space = 'query')::INT) OVER (PARTITION BY query_asm, method, svtype) AS q FROM r WHERE f IS NULL) SELECT query_asm, method, svtype, max(pred_calls) AS pred_calls FROM k WHERE q = 0 OR space = 'query' GROUP BY ALL"""
)
def reported_counts(t: Tables) -> DataFrame:
    """The largest reported count of a sample, caller and type."""
    rows = evaluated(t).select("query_asm", "method", "svtype", F.col("read_support").alias("pred_calls"), F.when(F.col("part") % 2 == 0, "query").otherwise("ref").alias("coordinate_space"), F.when(F.col("read_support") == 5, "x_any_clade").alias("filter"))
    return evaluation.predicted_counts(rows)


@query(f"WITH {_EV}, r AS (SELECT query_asm, CASE WHEN discount >= 0.09 THEN 'consensus_read_supported' WHEN discount >= 0.05 THEN 'consensus' ELSE 'other' END AS label FROM ev) SELECT query_asm, label, count(*) AS n FROM r WHERE label = 'consensus_read_supported' GROUP BY ALL")
def best_labels_only(t: Tables) -> DataFrame:
    """Rows with the best kind of truth label that there is."""
    label = F.when(F.col("discount") >= 0.09, "consensus_read_supported").when(F.col("discount") >= 0.05, "consensus").otherwise("other")
    return evaluation.wins_subset(evaluated(t).select("query_asm", label.alias("label")), "label").groupBy("query_asm", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {_EV}, m0 AS (SELECT contig, pos AS s, "end" AS e FROM ev WHERE discount >= 0.10), p AS (SELECT id, contig, pos, "end" AS e2 FROM ev WHERE svtype = 'TRA') SELECT DISTINCT id FROM p WHERE EXISTS (SELECT 1 FROM m0 WHERE m0.contig = p.contig AND m0.s <= p.e2 AND m0.e >= p.pos)""")
def calls_on_merged_hits(t: Tables) -> DataFrame:
    """Translocations that touch a merged hit."""
    hits = intervals.merged(evaluated(t).filter("discount >= 0.10").select("contig", F.col("pos").alias("s"), F.col("end").alias("e")), ["contig"], "s", "e").drop("n")
    rows = evaluated(t).filter("svtype = 'TRA'").select("id", "contig", "pos", "end")
    return intervals.overlap_join(rows, hits, "contig", ("pos", "end"), ("s", "e"), 100, 0, "left_semi").select("id").distinct()


#: Calls as callers give them.
_CV = f"{_CALLS}, cv AS (SELECT contig * 10 + line AS id, sample AS query, part AS reference, pos, \"end\", svtype, len AS svlen, price AS score, line AS anchors, 30.0 AS gq, CASE WHEN line <= 2 THEN 'length_delta' WHEN line = 3 THEN 'single_ref' ELSE 'mem_chain' END AS mode, CASE WHEN discount >= 0.08 THEN 'species' ELSE 'genus' END AS rank, CASE WHEN discount >= 0.05 THEN 'NOVEL' ELSE 'NOVEL_WEAK' END AS annotation FROM calls)"


def called(t: Tables) -> DataFrame:
    mode = F.when(F.col("line") <= 2, "length_delta").when(F.col("line") == 3, "single_ref").otherwise("mem_chain")
    return calls(t).select((F.col("contig") * 10 + F.col("line")).alias("id"), F.col("sample").alias("query"), F.col("part").alias("reference"), "pos", "end", "svtype", F.col("len").alias("svlen"), F.col("price").alias("score"), F.col("line").alias("anchors"), F.lit(30.0).alias("gq"), mode.alias("mode"),
        F.when(F.col("discount") >= 0.08, "species").otherwise("genus").alias("rank"), F.when(F.col("discount") >= 0.05, "NOVEL").otherwise("NOVEL_WEAK").alias("annotation"))


@query(f"WITH {_CV}, b AS (SELECT query, max(score) AS best FROM cv GROUP BY query) SELECT query, count(*) AS n FROM cv JOIN b USING (query) WHERE NOT (mode = 'length_delta' AND 4 * score < best) GROUP BY query")
def dominant_calls(t: Tables) -> DataFrame:
    """Fallback calls go where a chain is far better."""
    return callers.dominant_only(called(t)).groupBy("query").agg(F.count("*").alias("n"))


@query(f"WITH {_CV} SELECT svtype, count(*) AS n FROM (SELECT *, anchors - 1 AS a FROM cv) WHERE NOT (svtype IN ('INV', 'DUP', 'TRA') AND mode = 'single_ref' AND a < 3) GROUP BY svtype")
def low_coverage_calls(t: Tables) -> DataFrame:
    """Weak rearrangements go at low coverage."""
    rows = called(t).withColumn("anchors", F.col("anchors") - 1)
    return callers.low_coverage_filter(rows, "LOW").groupBy("svtype").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_CV} SELECT query, pos, svtype, svlen // 100 AS size, reference, round(score, 2) AS score, rank FROM cv QUALIFY row_number() OVER (PARTITION BY query, pos, svtype, svlen // 100, reference ORDER BY score DESC, CASE rank WHEN 'species' THEN 0 ELSE 1 END) = 1"""
)
def multi_rank_calls(t: Tables) -> DataFrame:
    """Of passes over several ranks the best call of each place stays."""
    best = callers.multi_rank(called(t), ["species", "genus"])
    return best.select("query", "pos", "svtype", F.floor(F.col("svlen") / 100).alias("size"), "reference", F.round("score", 2).alias("score"), "rank")


@query(
    f"""WITH {_CV}, s AS (SELECT *, svtype || ':' || (reference % 50) || ':' || (pos // 25) || ':' || greatest(1, svlen // 50) AS k, score + 2 * anchors + 0.001 * svlen + CASE WHEN annotation <> 'NOVEL_WEAK' THEN 5 ELSE 0 END AS support FROM cv) SELECT k, round(max(support), 3) AS support, count(*) AS n FROM s GROUP BY k"""
)
def read_mode_buckets(t: Tables) -> DataFrame:
    """The best supported call of each bucket of place and size in read modes."""
    rows = called(t).withColumn("reference", F.col("reference") % 50).withColumn("ref_pos", F.lit(None).cast("long"))
    key = F.concat_ws(":", "svtype", "reference", F.floor(F.col("pos") / 25), F.greatest(F.lit(1), F.floor(F.col("svlen") / 50)))
    support = F.col("score") + 2 * F.col("anchors") + 0.001 * F.col("svlen") + F.when(F.col("annotation") != "NOVEL_WEAK", 5.0).otherwise(0.0)
    best = callers.read_mode_dedup(rows).select(key.alias("k"), F.round(support, 3).alias("support"))
    return best.join(rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")), "k")


@query(
    """WITH p AS (SELECT p_partkey, p_size * 37 AS q, p_size * 20 + p_partkey % 300 AS r, (p_partkey % 30) / 100.0 AS ov FROM part), d AS (SELECT *, q - r AS delta FROM p)
    SELECT p_partkey, CASE WHEN abs(delta) >= 40 THEN CASE WHEN delta < 0 THEN 'DEL' ELSE 'INS' END END AS delta_type, CASE WHEN abs(delta) >= 40 THEN least(q // 4 + 1, r) END AS delta_pos,
      CASE WHEN ov >= 0.05 AND abs(delta) >= 40 AND abs(delta) <= greatest(40, least(q, r)) THEN least(q, r) // 2 END AS kmer_pos, CASE WHEN ov < 0.20 THEN CASE WHEN ov <= 0 THEN 'NOVEL' WHEN ov < 0.05 THEN 'NOVEL_WEAK' ELSE 'DIVERGED' END END AS novelty FROM d"""
)
def fallback_calls(t: Tables) -> DataFrame:
    """The fallbacks behind chains: by length, by k-mers, and off the reference."""
    rows = t.part.select("p_partkey", (F.col("p_size") * 37).alias("q"), (F.col("p_size") * 20 + F.col("p_partkey") % 300).alias("r"), ((F.col("p_partkey") % 30) / 100.0).alias("ov"))
    q, r, ov = map(F.col, ("q", "r", "ov"))
    found = rows.select("p_partkey", calling.length_delta_call(q, r).alias("a"), calling.kmer_fallback_call(q, r, ov).alias("b"), calling.off_reference_call(q, ov).alias("c"))
    return found.select("p_partkey", F.col("a.svtype").alias("delta_type"), F.col("a.pos").alias("delta_pos"), F.col("b.pos").alias("kmer_pos"), F.col("c.annotation").alias("novelty"))


@query(
    """WITH i AS (SELECT l_partkey AS s1, l_partkey + l_quantity::BIGINT AS e1, l_suppkey * 3 AS s2, l_suppkey * 3 + l_linenumber * 10 AS e2, l_orderkey AS k, l_linenumber AS line FROM lineitem)
    SELECT k, line, greatest(0, s2 - e1, s1 - e2) AS distance, CASE WHEN e1 < s2 OR e2 < s1 THEN 'PROPERLY_TRIALLELIC' WHEN (s1 <= s2 AND e2 <= e1) OR (s2 <= s1 AND e1 <= e2) THEN 'NESTED' ELSE 'OVERLAPPING' END AS topology,
      least(e1 - s1, e2 - s2) > 0 AND abs((e1 - s1) - (e2 - s2)) <= floor(0.10 * least(e1 - s1, e2 - s2) + 0.5) AS agree, s1 % 500 < 50 OR 500 - s1 % 500 < 50 AS near_edge FROM i"""
)
def interval_relations(t: Tables) -> DataFrame:
    """Distances, topologies, agreement of inversion lengths, and nearness to window edges."""
    i = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("s1"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e1"), (F.col("l_suppkey") * 3).alias("s2"), (F.col("l_suppkey") * 3 + F.col("l_linenumber") * 10).alias("e2"))
    s1, e1, s2, e2 = map(F.col, ("s1", "e1", "s2", "e2"))
    return i.select("k", "line", S.interval_distance(s1, e1, s2, e2).alias("distance"), S.topology(s1, e1, s2, e2).alias("topology"), S.inversion_lengths_agree(e1 - s1, e2 - s2).alias("agree"), E.near_boundary(s1, 500, 50).alias("near_edge"))


@query(
    """WITH e AS (SELECT ['HGT', 'TE_LTR', 'LINE', 'RIP', 'STARSHIP'][o_custkey % 5 + 1] AS element, o_orderkey % 3 - 1 AS reads, o_custkey % 4 AS anchors, o_orderkey % 2 AS layers FROM orders)
    SELECT CASE WHEN element = 'HGT' THEN 'HGT / Starship' WHEN element IN ('TE_LTR', 'LINE') THEN 'TE / repeat' WHEN element = 'RIP' THEN 'RIP / genome defense' ELSE element END AS grp, count(*) AS n,
      sum(CASE WHEN anchors > 0 THEN anchors WHEN layers > 0 THEN layers ELSE 0 END)::BIGINT AS read_support, sum(CASE WHEN reads >= 0 THEN reads WHEN anchors > 0 THEN anchors ELSE layers END)::BIGINT AS assembly_support FROM e GROUP BY ALL"""
)
def element_support(t: Tables) -> DataFrame:
    """Report groups of element classes and the effective support of their calls in both kinds of modes."""
    names = F.array(*map(F.lit, ("HGT", "TE_LTR", "LINE", "RIP", "STARSHIP")))
    e = t.orders.select(F.get(names, (F.col("o_custkey") % 5).cast("int")).alias("element"), (F.col("o_orderkey") % 3 - 1).alias("support"), (F.col("o_custkey") % 4).alias("anchors"), (F.col("o_orderkey") % 2).alias("layers"))
    support = lambda reads: F.sum(S.effective_support(F.lit(reads), F.col("anchors"), F.col("layers"), F.col("support")))
    return e.groupBy(S.element_group(F.col("element")).alias("grp")).agg(F.count("*").alias("n"), support(True).alias("read_support"), support(False).alias("assembly_support"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey % 12 AS anchors, (o_orderkey % 60)::DOUBLE AS mapq, 20.0 AS gq, o_totalprice / 1000 AS score, (o_custkey % 30) / 100.0 AS ov, ['DEL', 'INV', 'TRA', 'OFF_REF'][o_orderkey % 4 + 1] AS t, CASE WHEN o_custkey % 2 = 0 THEN 'mem_chain' ELSE 'simple_length_fallback' END AS mode, ['assembly', 'long', 'short'][o_custkey % 3 + 1] AS qm FROM orders),
    f AS (SELECT *, t = 'TRA' AND score >= 6 AND anchors >= 2 AS strong FROM o), g AS (SELECT *, t = 'INV' OR (t = 'TRA' AND NOT strong) AS doubtful, t = 'TRA' AND NOT strong AND ov < 0.10 AS homeless FROM f)
    SELECT k, CASE qm WHEN 'assembly' THEN 'ASM' WHEN 'long' THEN 'LR' ELSE 'SR' END AS layer, round((greatest(1, anchors) * CASE WHEN qm = 'assembly' THEN 1.5 ELSE 0.25 END)::DOUBLE, 6) AS depth,
      round(least(1, 0.08 * anchors + CASE WHEN mode = 'mem_chain' THEN 0.25 ELSE 0 END + CASE WHEN t IN ('TRA', 'INV') THEN 0.10 ELSE 0 END)::DOUBLE, 6) AS bp, round(least(1, ov + CASE WHEN mode <> 'mem_chain' THEN 0.20 ELSE 0 END + CASE WHEN t = 'OFF_REF' THEN 0.15 ELSE 0 END), 6) AS span,
      round(ln(1 + score) + 0.18 * anchors + 0.03 * mapq + 0.03 * gq + 2.5 * ov + CASE WHEN t = 'OFF_REF' THEN 0.60 ELSE CASE WHEN mode = 'mem_chain' THEN 0.45 ELSE 0.25 END - CASE WHEN doubtful AND ov < 0.10 THEN 2.5 ELSE 0 END - CASE WHEN homeless THEN 1 ELSE 0 END END, 6) AS alt,
      round(0.85 + CASE WHEN t = 'OFF_REF' THEN 2.2 * ov ELSE CASE WHEN ov < 0.02 THEN 1.5 ELSE 0 END + CASE WHEN doubtful AND ov < 0.05 THEN 0.75 ELSE 0 END + CASE WHEN doubtful AND ov < 0.10 THEN 5 + (0.10 - ov) * 20 ELSE 0 END + CASE WHEN homeless THEN 2 ELSE 0 END END, 6) AS ref FROM g"""
)
def evidence_observations(t: Tables) -> DataFrame:
    """Terms of each call's observation of evidence."""
    kinds, modes = F.array(*map(F.lit, ("DEL", "INV", "TRA", "OFF_REF"))), F.array(*map(F.lit, ("assembly", "long", "short")))
    o = t.orders.select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 12).alias("anchors"), (F.col("o_orderkey") % 60).cast("double").alias("mapq"), F.lit(20.0).alias("gq"), (F.col("o_totalprice") / 1000).alias("score"), ((F.col("o_custkey") % 30) / 100.0).alias("ov"),
        F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("svtype"), F.when(F.col("o_custkey") % 2 == 0, "mem_chain").otherwise("simple_length_fallback").alias("mode"), F.get(modes, (F.col("o_custkey") % 3).cast("int")).alias("query_mode"), F.lit("NOVEL").alias("annotation"), F.lit(None).cast("string").alias("mate_contig"),
    )
    terms = E.observation({c: F.col(c) for c in o.columns}, F.col("ov"), F.lit(1.5), F.lit(0.1))
    return o.select("k", terms["layer"].alias("layer"), *[F.round(terms[c], 6).alias(c) for c in ("depth", "bp", "span", "alt", "ref")])


@query(f"""WITH {_EV} SELECT id, CASE WHEN svtype = 'TRA' THEN 'TRA:' || contig || ':' || greatest(1, pos) || '-' || greatest(1, pos, "end") || '->' || mate_contig || ':' || greatest(1, mate_pos) || '-' || greatest(1, mate_pos) ELSE svtype || ':' || greatest(1, pos) || '-' || greatest(1, pos, "end") END AS breakpoints, CASE WHEN length(contig) > 2 THEN 'x' ELSE '.' END AS mark FROM ev""")
def ancestral_rows(t: Tables) -> DataFrame:
    """The table of ancestral sequences of all calls: breakpoints in words, '.' for what is not known."""
    rows = evaluated(t).select("id", "query_asm", F.col("contig").alias("query_contig"), F.col("svtype").alias("type"), F.lit("r").alias("ref_asm"), F.col("contig").alias("ref_contig"), "pos", "end", "svlen", "mate_contig", "mate_pos", F.when(F.length("contig") > 2, "x").otherwise("").alias("phylum"))
    out = tables.ancestral_table(rows.withColumn("query_asm", F.col("id").cast("string")))
    return out.select(F.col("query_asm").cast("long").alias("id"), "breakpoints", F.col("phylum").alias("mark"))


@query(
    f"""WITH {_EV}, s AS (SELECT {_LOCUS} AS locus, count(DISTINCT method) AS n FROM ev WHERE discount >= 0.08 GROUP BY ALL), g AS (SELECT DISTINCT {_LOCUS} AS locus FROM ev WHERE single_reference), r AS (SELECT id, {_LOCUS} AS locus FROM ev WHERE status = 'F')
    SELECT id, coalesce(n, 0) AS comparator_support_count, CASE WHEN g.locus IS NOT NULL THEN 'yes' ELSE 'no' END AS single_reference_equivalent, CASE WHEN g.locus IS NULL AND coalesce(n, 0) = 0 THEN 'yes' ELSE 'no' END AS "unique", CASE WHEN n IS NOT NULL THEN 'strong' ELSE '.' END AS evidence_tier
    FROM r LEFT JOIN s USING (locus) LEFT JOIN g USING (locus)"""
)
def joined_findings(t: Tables) -> DataFrame:
    """Candidates with comparators' support, single-reference equivalents and tiers."""
    rows = evaluated(t)
    support = rows.filter("discount >= 0.08").select(evaluation.locus_key().alias("locus"), F.col("method").alias("source"))
    found = biology.findings(rows.filter("status = 'F'"), support, rows.filter("single_reference"), support.select("locus", F.lit("strong").alias("tier")))
    return found.select("id", "comparator_support_count", "single_reference_equivalent", "unique", "evidence_tier")


@query(
    f"""WITH {_EV}, w AS (SELECT * FROM (VALUES ('F', 'm0'), ('F', 'm1'), ('O', 'm2'), ('O', 'm9')) AS v(query_mode, method)), c AS (SELECT status AS query_mode, method, count(*) AS calls, count(*) FILTER (WHERE svtype = 'TRA') AS off_ref, count(*) FILTER (WHERE contig NOT IN ('c1', 'c2', 'c3')) AS misrouted FROM ev GROUP BY ALL)
    SELECT query_mode, method, coalesce(calls, 0) AS calls, coalesce(off_ref, 0) AS off_ref, coalesce(misrouted, 0) AS misrouted, coalesce(calls, 0) > 0 AS present FROM w LEFT JOIN c USING (query_mode, method)"""
)
def comparator_outputs(t: Tables) -> DataFrame:
    """Which callers gave output in each mode, and how much of it is off the reference or elsewhere."""
    rows = evaluated(t).select(F.col("status").alias("query_mode"), "method", "contig", F.when(F.col("svtype") == "TRA", "OFF_REF").otherwise(F.col("svtype")).alias("svtype"))
    return biology.comparators(rows, {"F": ["m0", "m1"], "O": ["m2", "m9"]}, t.spark.createDataFrame([("c1",), ("c2",), ("c3",)], "contig string"))


@query(f"WITH {_EV}, a AS (SELECT query_asm, contig, svtype FROM ev WHERE discount >= 0.08), b AS (SELECT query_asm, contig, svtype FROM ev WHERE svtype = 'TRA') SELECT query_asm, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY query_asm")
def combined_rows(t: Tables) -> DataFrame:
    """Two tables of calls as one without exact duplicates."""
    rows = evaluated(t)
    names = ["query_asm", "contig", "svtype"]
    return biology.combined(rows.filter("discount >= 0.08").select(*names), rows.filter("svtype = 'TRA'").select(*names)).groupBy("query_asm").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_EV}, n AS (SELECT query_asm, contig, pos, "end", svtype, max(id) AS id FROM ev WHERE NOT single_reference GROUP BY ALL), b AS (SELECT query_asm, contig, pos, "end", svtype, max(discount) AS trait FROM ev WHERE discount >= 0.05 GROUP BY ALL)
    SELECT id, round(trait, 2) AS trait FROM n LEFT JOIN b USING (query_asm, contig, pos, "end", svtype)"""
)
def novel_with_biology(t: Tables) -> DataFrame:
    """Novel calls with their biology, whatever the form of the assembly's name."""
    keys = ["query_asm", "contig", "pos", "end", "svtype"]
    novel = evaluated(t).filter("NOT single_reference").groupBy(*keys).agg(F.max("id").alias("id"))
    known = evaluated(t).filter("discount >= 0.05").groupBy(*keys).agg(F.max("discount").alias("trait")).withColumn("query_asm", F.concat(F.lit("/x/"), F.upper("query_asm"), F.lit(".fa")))
    return biology.with_biology(novel, known).select("id", F.round("trait", 2).alias("trait"))


@query(f"WITH {_EV} SELECT reference, count(*) AS n FROM ev, (VALUES ('r0', 'asm0'), ('r1', 'asm1'), ('r2', 'asm2')) AS v(reference, species) WHERE svtype = 'TRA' AND query_asm <> species GROUP BY reference")
def truth_against_others(t: Tables) -> DataFrame:
    """True calls against representatives of other species."""
    truth = evaluated(t).filter("svtype = 'TRA'").withColumn("species", F.col("query_asm"))
    reps = t.spark.createDataFrame([(f"r{i}", f"asm{i}") for i in range(3)], "reference string, species string")
    return biology.truth_of_others(truth, reps).groupBy("reference").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_EV}, s AS (SELECT contig, pos, "end", svtype, max(svlen) AS svlen, max(CASE WHEN query_asm = 'asm0' THEN gt END) AS a, max(CASE WHEN query_asm = 'asm1' THEN gt END) AS b FROM (SELECT *, CASE WHEN discount >= 0.05 THEN '1/1' ELSE '0/1' END AS gt FROM ev) GROUP BY contig, pos, "end", svtype)
    SELECT contig, pos, CASE svtype WHEN 'DEL' THEN -svlen WHEN 'TRA' THEN 0 ELSE svlen END AS svlen, coalesce(a, '0/0') AS gt0, coalesce(b, '0/0') AS gt1 FROM s WHERE a IS NOT NULL OR b IS NOT NULL"""
)
def multisample_vcf(t: Tables) -> DataFrame:
    """Calls as multi-sample VCF lines, read again."""
    rows = evaluated(t).select("query_asm", F.col("contig").alias("query_contig"), "pos", "end", F.col("svtype").alias("type"), "svlen", F.when(F.col("discount") >= 0.05, "1/1").otherwise("0/1").alias("genotype"), F.lit(30.0).alias("gq"), F.lit("assembly").alias("query_mode"))
    path = scratch_path(t.spark, "multisample")
    tables.multisample_lines(rows, ["asm0", "asm1"]).select("value").write.text(path)
    return tables.read_vcf(t.spark, path).select("contig", "pos", "svlen", F.get("samples", F.lit(0)).alias("gt0"), F.get("samples", F.lit(1)).alias("gt1"))


@query(f"WITH {_EV}, c AS (SELECT query_asm, method, count(*) AS pred_calls, count(*) FILTER (WHERE discount >= 0.05) AS tp FROM ev GROUP BY ALL) SELECT method, count(DISTINCT query_asm) AS samples, median(pred_calls) AS median_calls, sum(pred_calls)::BIGINT AS total_calls, round(sum(tp) / sum(pred_calls), 6) AS rate FROM c GROUP BY method")
def methods_side_by_side(t: Tables) -> DataFrame:
    """Methods: samples, median and total calls, validated share."""
    c = evaluated(t).groupBy("query_asm", "method").agg(F.count("*").alias("pred_calls"), F.count_if(F.col("discount") >= 0.05).alias("tp"))
    return panels.method_table(c).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_EV}, c AS (SELECT query_asm, method, count(*) AS n, count(*) FILTER (WHERE discount >= 0.05) AS tp FROM ev GROUP BY ALL) SELECT query_asm, coalesce(max(n) FILTER (WHERE method = 'm0'), 0) AS m0, coalesce(max(n) FILTER (WHERE method = 'm1'), 0) AS m1, max(tp) AS consensus_tp FROM c GROUP BY query_asm")
def callers_by_sample(t: Tables) -> DataFrame:
    """Counts of each sample by caller."""
    c = evaluated(t).groupBy("query_asm", "method").agg(F.count("*").alias("pred_calls"), F.count_if(F.col("discount") >= 0.05).alias("tp"))
    return panels.caller_pivot(c, ["m0", "m1"])


@query(f"""WITH {_EV}, e AS (SELECT query_asm, CASE WHEN discount >= 0.08 THEN 'HGT' WHEN discount >= 0.05 THEN 'RIP' END AS element FROM ev) SELECT element, coalesce(query_asm, 'PANEL') AS query_asm, count(*) AS n FROM e WHERE element IS NOT NULL GROUP BY GROUPING SETS ((element), (element, query_asm))""")
def reannotated(t: Tables) -> DataFrame:
    """Element classes of each genome and of the panel."""
    element = F.when(F.col("discount") >= 0.08, "HGT").when(F.col("discount") >= 0.05, "RIP")
    return panels.reannotation(evaluated(t).select("query_asm", element.alias("element")))


@query(
    f"""WITH {_EV}, r AS (SELECT 'g' || (part % 4) AS guild, contig AS shard, read_support AS priority, CASE WHEN discount >= 0.08 THEN 'hgt_candidate' WHEN discount >= 0.05 THEN 'te_clade_switch' ELSE 'structural' END AS class, discount < 0.02 AS supported FROM ev)
    SELECT guild, count(*) AS candidates, count(DISTINCT shard) AS shards, round(avg(priority), 4) AS mean_priority, count(*) FILTER (WHERE class LIKE 'hgt%') AS hgt, count(*) FILTER (WHERE class LIKE '%te\\_%' ESCAPE '\\') AS te, count(*) FILTER (WHERE class LIKE '%switch%') AS switch, count(*) FILTER (WHERE supported) AS supported FROM r GROUP BY guild"""
)
def guild_candidates(t: Tables) -> DataFrame:
    """Candidates of each guild."""
    kind = F.when(F.col("discount") >= 0.08, "hgt_candidate").when(F.col("discount") >= 0.05, "te_clade_switch").otherwise("structural")
    rows = evaluated(t).select(F.concat(F.lit("g"), F.col("part") % 4).alias("guild"), F.col("contig").alias("shard"), F.col("read_support").alias("priority"), kind.alias("class"), (F.col("discount") < 0.02).alias("supported"))
    return panels.guild_summary(rows).drop("top_classes")


@query(f"WITH {_TAXONOMY}, l AS (SELECT 'asm' || sample AS query_asm, sample AS n FROM tax WHERE sample % 2 = 0 UNION ALL SELECT 'ALL', -1) SELECT 'asm' || sample AS sample, coalesce(l.n, -1) AS n FROM tax LEFT JOIN l ON l.query_asm = 'asm' || sample")
def layers_by_sample(t: Tables) -> DataFrame:
    """Each sample's own row, else the shared one."""
    own = taxonomy(t).select(F.concat(F.lit("asm"), "sample").alias("query_asm"), F.col("sample").alias("n"))
    layers = own.filter("n % 2 = 0").union(t.spark.createDataFrame([("ALL", -1)], "query_asm string, n long"))
    return panels.layer_rows(layers, own).select("sample", "n")


@query(f"WITH {_TAXONOMY} SELECT 'ok' AS verdict, count(*) AS entries, 0 AS without_path, count(DISTINCT clade) AS clades FROM tax")
def registry_check(t: Tables) -> DataFrame:
    """One row on the registry: entries, missing paths, clades, and a verdict."""
    manifest = taxonomy(t).select(F.col("clade").alias("clade_name"), F.concat(F.lit("/x/"), "sample").alias("fasta_path"))
    found = panels.registry_diagnosis(manifest, manifest.select(F.col("fasta_path").alias("value")))
    return found.select("verdict", "entries", "without_path", "clades")


@query("SELECT r_name AS phylum, CASE r_name WHEN 'AFRICA' THEN 3 ELSE 3 END AS place, count(*) AS n FROM region GROUP BY ALL UNION ALL SELECT 'Glomeromycota', 0, 1 UNION ALL SELECT 'Ascomycota', 2, 1")
def phyla_in_order(t: Tables) -> DataFrame:
    """Places of phyla in panels, those that are not listed last."""
    rows = t.region.select(F.col("r_name").alias("phylum")).union(t.spark.createDataFrame([("Glomeromycota",), ("Ascomycota",)], "phylum string"))
    return rows.groupBy("phylum", panels.phylum_order(F.col("phylum")).alias("place")).agg(F.count("*").alias("n"))


#: Groups of one contig and type, in the order of the greedy choice.
_GREEDY = f"""{_CALLS}, o AS (SELECT contig, svtype, pos, "end", price, part, line, row_number() OVER (PARTITION BY contig, svtype ORDER BY price DESC, pos, "end", part, line) AS k FROM calls)"""


@query(
    f"""WITH RECURSIVE {_GREEDY}, g AS (
      SELECT contig, svtype, 0::BIGINT AS k, []::STRUCT(a BIGINT, b BIGINT)[] AS taken, false AS took FROM (SELECT DISTINCT contig, svtype FROM o)
      UNION ALL SELECT g.contig, g.svtype, o.k, CASE WHEN len(list_filter(g.taken, lambda x: NOT (x.b + 20 < o.pos OR o."end" + 20 < x.a))) = 0 THEN list_append(g.taken, {{'a': o.pos, 'b': o."end"}}) ELSE g.taken END, len(list_filter(g.taken, lambda x: NOT (x.b + 20 < o.pos OR o."end" + 20 < x.a))) = 0
      FROM g JOIN o ON o.contig = g.contig AND o.svtype = g.svtype AND o.k = g.k + 1)
    SELECT o.contig, o.svtype, o.pos, o."end", o.part, o.line FROM g JOIN o USING (contig, svtype, k) WHERE took"""
)
def nonoverlapping_calls(t: Tables) -> DataFrame:
    """Greedy choice by score of calls that keep their distance, against a recursion over ranks."""
    rows = calls(t).select("contig", "svtype", "pos", "end", "price", "part", "line")
    return selection.non_overlapping(rows, ["contig", "svtype"], "pos", "end", "price", 20).drop("price")


@query(
    f"""WITH RECURSIVE {_CALLS}, o AS (SELECT contig % 300 AS contig, pos, part, line, row_number() OVER (PARTITION BY contig % 300 ORDER BY pos, part, line) AS k FROM calls WHERE svtype = 'INV'),
    g AS (SELECT contig, k, pos AS head, 0 AS cluster FROM o WHERE k = 1 UNION ALL SELECT g.contig, o.k, CASE WHEN o.pos - g.head > 30 THEN o.pos ELSE g.head END, g.cluster + CASE WHEN o.pos - g.head > 30 THEN 1 ELSE 0 END FROM g JOIN o ON o.contig = g.contig AND o.k = g.k + 1)
    SELECT contig, cluster, count(*) AS n, min(pos) AS first FROM g JOIN o USING (contig, k) GROUP BY contig, cluster"""
)
def clustered_inversions(t: Tables) -> DataFrame:
    """Clusters of inversions by distance to a cluster's first member, against a recursion over positions."""
    rows = calls(t).filter("svtype = 'INV'").select((F.col("contig") % 300).alias("contig"), "pos", "part", "line")
    return selection.greedy_clusters(rows, ["contig"], "pos", 30).groupBy("contig", "cluster").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(
    f"""WITH RECURSIVE {_CALLS}, r AS (SELECT contig, svtype, status, pos, len, min(part) AS id FROM calls GROUP BY ALL),
    p AS (SELECT t.contig, t.svtype, t.id AS tid, c.id AS cid, t.pos AS tp, c.pos AS cp, abs(t.pos - c.pos) + abs(t.len - c.len) AS d FROM r t JOIN r c ON t.contig = c.contig AND t.svtype = c.svtype AND t.status = 'O' AND c.status = 'F' AND abs(t.pos - c.pos) <= 400 AND abs(t.len - c.len) <= 10.0 * greatest(1, t.len)),
    o AS (SELECT *, row_number() OVER (PARTITION BY contig, svtype ORDER BY d, tid, cid, tp, cp) AS k FROM p),
    g AS (SELECT contig, svtype, 0::BIGINT AS k, []::VARCHAR[] AS used, false AS took FROM (SELECT DISTINCT contig, svtype FROM o)
      UNION ALL SELECT g.contig, g.svtype, o.k, CASE WHEN NOT list_contains(g.used, 't' || o.tid || ':' || o.tp) AND NOT list_contains(g.used, 'c' || o.cid || ':' || o.cp) THEN list_concat(g.used, ['t' || o.tid || ':' || o.tp, 'c' || o.cid || ':' || o.cp]) ELSE g.used END,
        NOT list_contains(g.used, 't' || o.tid || ':' || o.tp) AND NOT list_contains(g.used, 'c' || o.cid || ':' || o.cp) FROM g JOIN o ON o.contig = g.contig AND o.svtype = g.svtype AND o.k = g.k + 1)
    SELECT contig, svtype, tid AS truth_id, cid AS call_id, d AS distance FROM g JOIN o USING (contig, svtype, k) WHERE took"""
)
def matched_calls(t: Tables) -> DataFrame:
    """One-to-one matches of calls to truth, nearest first, against a recursion over sorted pairs."""
    rows = distinct_calls(t)
    return selection.greedy_match(rows.filter("status = 'O'"), rows.filter("status = 'F'"), ["contig", "svtype"], 400, 10.0)


@query(
    f"""WITH RECURSIVE {_CALLS}, r AS (SELECT contig % 200 AS q, line AS id2, status, pos, contig * 10 + line AS id FROM calls), p AS (SELECT t.q, t.id AS truth_id, c.id AS call_id, abs(t.pos - c.pos) AS distance FROM r t JOIN r c ON t.q = c.q AND t.status = 'O' AND c.status = 'F' AND abs(t.pos - c.pos) <= 60),
    o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, truth_id, call_id) AS k FROM p),
    g AS (SELECT q, 0::BIGINT AS k, []::BIGINT[] AS ts, []::BIGINT[] AS cs, false AS took FROM (SELECT DISTINCT q FROM o)
      UNION ALL SELECT g.q, o.k, CASE WHEN NOT list_contains(g.ts, o.truth_id) AND NOT list_contains(g.cs, o.call_id) THEN list_append(g.ts, o.truth_id) ELSE g.ts END, CASE WHEN NOT list_contains(g.ts, o.truth_id) AND NOT list_contains(g.cs, o.call_id) THEN list_append(g.cs, o.call_id) ELSE g.cs END,
        NOT list_contains(g.ts, o.truth_id) AND NOT list_contains(g.cs, o.call_id) FROM g JOIN o ON o.q = g.q AND o.k = g.k + 1)
    SELECT truth_id, call_id, distance FROM g JOIN o USING (q, k) WHERE took"""
)
def mutual_best_matches(t: Tables) -> DataFrame:
    """One-to-one matches by place alone, nearest first, by scans of sorted places: against a recursion over sorted pairs."""
    r = calls(t).select((F.col("contig") % 200).alias("q"), "status", "pos", (F.col("contig") * 10 + F.col("line")).alias("id"))
    one, two = r.filter("status = 'O'").withColumnRenamed("id", "truth_id"), r.filter("status = 'F'").withColumnRenamed("id", "call_id")
    return evaluation.nearest_matches(one, two, "q", 60)


_TRA = f"""{_CALLS}, u AS (SELECT DISTINCT contig, part, line, pos, len, price FROM calls),
    v AS (SELECT concat_ws('-', contig, part, line, pos, len, floor(price * 100)::BIGINT) AS id, contig % 40 AS c1, pos AS p1, part % 40 AS c2, (part * 7919) % 2500 + 1 AS p2, price, len FROM u),
    w AS (SELECT id, price, len, CASE WHEN (c2, p2) < (c1, p1) THEN c2 ELSE c1 END AS a, CASE WHEN (c2, p2) < (c1, p1) THEN c1 ELSE c2 END AS b, CASE WHEN (c2, p2) < (c1, p1) THEN p2 ELSE p1 END AS x, CASE WHEN (c2, p2) < (c1, p1) THEN p1 ELSE p2 END AS y FROM v),
    o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY -price, -len, id) AS k FROM w)"""


@query(
    f"""WITH RECURSIVE {_TRA}, g AS (SELECT a, b, 0::BIGINT AS k, []::STRUCT(id VARCHAR, x BIGINT, y BIGINT)[] AS kept, NULL::VARCHAR AS rep FROM (SELECT DISTINCT a, b FROM o)
      UNION ALL SELECT a, b, k, CASE WHEN hit IS NULL THEN list_append(kept, {{'id': id, 'x': x, 'y': y}}) ELSE kept END, coalesce(hit.id, id)
      FROM (SELECT o.a, o.b, o.k, o.id, o.x, o.y, g.kept, list_filter(g.kept, lambda t: abs(t.x - o.x) <= 200 AND abs(t.y - o.y) <= 200)[1] AS hit FROM g JOIN o ON o.a = g.a AND o.b = g.b AND o.k = g.k + 1))
    SELECT o.id, rep FROM g JOIN o USING (a, b, k)"""
)
def translocation_clusters(t: Tables) -> DataFrame:
    """Translocations of two contigs with both ends near are one, whichever end is the mate, and the best stands for them; against a recursion in order of quality."""
    rows = calls(t).select("contig", "part", "line", "pos", "len", "price").distinct()
    ends = rows.select(F.concat_ws("-", "contig", "part", "line", "pos", "len", F.floor(F.col("price") * 100)).alias("id"), (F.col("contig") % 40).alias("c1"), F.col("pos").alias("p1"), (F.col("part") % 40).alias("c2"), ((F.col("part") * 7919) % 2500 + 1).alias("p2"), "price", "len")
    turned = F.struct("c2", "p2") < F.struct("c1", "p1")
    pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    placed = ends.select("id", "price", "len", pick("c2", "c1").alias("a"), pick("c1", "c2").alias("b"), pick("p2", "p1").alias("x"), pick("p1", "p2").alias("y"))
    found = selection.represented(placed, ["a", "b"], "id", ["x", "y"], [(-F.col("price")).alias("_v"), (-F.col("len")).alias("_n")], 200)
    return found.select("id", F.col("representative").alias("rep"))


_WINDOW = 40
#: Both axes of calls taken in file order: each group of a query and type is a recursion over its calls, which keeps the truths that are used.
_TURNS = f"""{_CALLS}, u AS (SELECT DISTINCT contig, line, part, pos, len, svtype, status FROM calls),
    r AS (SELECT contig % 300 AS q, svtype, status, pos, len, row_number() OVER (ORDER BY contig, line, part, pos, len, svtype, status) AS id, concat_ws('-', contig, line, part, pos, len, svtype) AS name, part % 3 <> 0 AS same FROM u),
    tl AS (SELECT q, svtype, list({{'id': id, 'pos': pos, 'len': len}} ORDER BY id) AS ts FROM r WHERE status = 'O' GROUP BY ALL),
    o AS (SELECT axis, q, svtype, id, pos, len, same, row_number() OVER (PARTITION BY axis, q, svtype ORDER BY id) AS k FROM r, (VALUES ('single'), ('pangenome')) AS x(axis) WHERE status = 'F' AND (same OR axis = 'pangenome') AND q IN (SELECT q FROM tl)),
    n AS (SELECT axis, q, svtype, k, id, same, list_sort(list_transform(list_filter(coalesce(ts, []), lambda x: abs(x.pos - o.pos) <= {_WINDOW} AND (svtype <> 'DEL' OR abs(x.len - o.len) <= {_WINDOW})), lambda x: {{'d': abs(x.pos - o.pos), 'i': x.id}})) AS near FROM o LEFT JOIN tl USING (q, svtype)),
    g AS (SELECT axis, q, svtype, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS truth_id, NULL::BIGINT AS distance FROM (SELECT DISTINCT axis, q, svtype FROM n)
      UNION ALL SELECT axis, q, svtype, k, CASE WHEN c IS NULL THEN used ELSE list_append(used, c.i) END, c.i, c.d
      FROM (SELECT g.axis, g.q, g.svtype, n.k, g.used, list_filter(n.near, lambda x: NOT list_contains(g.used, x.i))[1] AS c FROM g JOIN n ON n.axis = g.axis AND n.q = g.q AND n.svtype = g.svtype AND n.k = g.k + 1))"""


def _in_turn(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Truths and calls of queries, in the order of their numbers."""
    q = F.col("contig") % 300
    place = ["contig", "line", "part", "pos", "len", "svtype"]
    distinct = calls(t).select(*place, "status").distinct().withColumns({"id": F.concat_ws("-", *place), "_o": F.struct(*place)})
    rows = distinct.select(q.cast("string").alias("query_asm"), F.lit("c").alias("contig"), "svtype", "pos", F.col("len").alias("svlen"), "status", "id", "_o", F.concat(F.lit("S"), q % 4).alias("scenario"), (F.col("part") % 3 != 0).alias("same_scenario"))
    truth = rows.filter("status = 'O'").withColumns({"truth_id": F.col("id"), "truth_order": F.col("_o")})
    return truth, rows.filter("status = 'F'").withColumns({"call_id": F.col("id"), "call_order": F.col("_o")})


@query(f"WITH RECURSIVE {_TURNS} SELECT c.name AS call_id, w.name AS truth_id, distance FROM g JOIN n USING (axis, q, svtype, k) JOIN r c ON c.id = n.id JOIN r w ON w.id = truth_id WHERE axis = 'pangenome' AND truth_id IS NOT NULL")
def matches_in_file_order(t: Tables) -> DataFrame:
    """Each call in turn takes the nearest truth that no earlier one has: by scans in order, against a recursion over turns."""
    return evaluation.matched_in_turn(*_in_turn(t), _WINDOW).filter("truth_id IS NOT NULL").select("call_id", "truth_id", "distance")


@query(
    f"""WITH RECURSIVE {_TURNS}, h AS (SELECT n.axis, n.q, count(*) FILTER (WHERE truth_id IS NOT NULL) AS tp, count(*) FILTER (WHERE truth_id IS NULL AND same) AS fp FROM n JOIN g USING (axis, q, svtype, k) GROUP BY ALL),
    c AS (SELECT q, count(*) AS truth_calls FROM r WHERE status = 'O' GROUP BY q),
    s AS (SELECT axis, 'S' || (q % 4) AS scenario, truth_calls, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM c CROSS JOIN (VALUES ('single'), ('pangenome')) AS x(axis) LEFT JOIN h USING (axis, q)),
    z AS (SELECT axis, coalesce(scenario, 'PANEL') AS scenario, sum(truth_calls)::BIGINT AS truth_calls, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp FROM s GROUP BY GROUPING SETS ((axis, scenario), (axis)))
    SELECT axis, scenario, truth_calls, tp, fp, truth_calls - tp AS fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / truth_calls, 9) AS recall FROM z"""
)
def two_axis_scores(t: Tables) -> DataFrame:
    """Precision and recall of a single reference and of the pangenome, by scenario and in all."""
    out = evaluation.two_axis(*_in_turn(t), _WINDOW)
    return out.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


#: Two-sided normal tails: erf is exp(-x*x) times the sum of x^(2n+1) / gamma(n + 3/2), all of one sign.
WELCH = """WITH s AS (SELECT user_id % 20 AS grp, event_type, avg(value) AS m, coalesce(var_samp(value), 0) AS v, count(*) AS n FROM events GROUP BY ALL),
    z AS (SELECT a.grp, a.event_type, b.event_type AS other, abs(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) / sqrt(2) AS x FROM s a JOIN s b ON a.grp = b.grp AND a.event_type < b.event_type)
    SELECT grp, event_type, other, round(CASE WHEN x = 0 THEN 1 WHEN x > 6 THEN 0 ELSE 1 - exp(-x * x) * list_sum([exp((2 * i + 1) * ln(x) - lgamma(i + 1.5)) FOR i IN range(0, 250)]) END, {0}) AS p FROM z"""


@query(WELCH.format(4))
def welch_tests(t: Tables) -> DataFrame:
    """Welch tests between event types of each user group, to four places."""
    from strandlake.functions import stats

    s = t.events.groupBy((F.col("user_id") % 20).alias("grp"), "event_type").agg(F.avg("value").alias("m"), stats.sample_variance(F.col("value")).alias("v"), F.count("*").alias("n"))
    b = s.select("grp", F.col("event_type").alias("other"), F.col("m").alias("m2"), F.col("v").alias("v2"), F.col("n").alias("n2"))
    both = s.join(b, "grp").filter(F.col("event_type") < F.col("other"))
    return both.select("grp", "event_type", "other", F.round(stats.welch("m", "v", "n", "m2", "v2", "n2"), 4).alias("p"))


#: The first versions of these queries, whose rows the recursions above give too.
ORACLE_SQL["greedy_match_tolerance"] = ORACLE_SQL["matched_calls"]
ORACLE_SQL["nonoverlap_selection"] = ORACLE_SQL["nonoverlapping_calls"].replace('SELECT o.contig, o.svtype, o.pos, o."end", o.part, o.line', 'SELECT o.contig, o.svtype, o.pos, o."end", o.price, o.part, o.line')
ORACLE_SQL["greedy_cluster_inversions"] = ORACLE_SQL["clustered_inversions"].replace("SELECT contig, cluster, count(*) AS n, min(pos) AS first FROM g JOIN o USING (contig, k) GROUP BY contig, cluster", "SELECT contig, pos, part, line, cluster FROM g JOIN o USING (contig, k)")
ORACLE_SQL["cross_clade_overlaps"] = ORACLE_SQL["cross_clade_tiers"].replace("round(same_overlap, 6) AS same_overlap, round(other_overlap, 6) AS other_overlap", "same_overlap, other_overlap")
ORACLE_SQL["welch_normal"] = WELCH.format(9)
