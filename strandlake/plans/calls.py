"""Queries that read lineitem as variant calls: joins, aggregates, matching, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import scores as S
from strandlake.functions import stats
from strandlake.operators import intervals, selection
from strandlake.operators.calling import priority
from strandlake.plans.registry import Tables, query

_CALLS = """calls AS (SELECT l_orderkey AS contig, l_partkey AS part, l_suppkey AS sample, l_linenumber AS line,
    date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS pos, l_quantity::BIGINT AS len, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS "end",
    CASE l_returnflag WHEN 'A' THEN 'DEL' WHEN 'N' THEN 'INS' ELSE 'INV' END AS svtype, l_linestatus AS status, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""


def calls(t: Tables) -> DataFrame:
    """lineitem as calls: contig, part, sample, line, pos, end, len, svtype, status, price, discount, tax."""
    pos = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    size = F.col("l_quantity").cast("long")
    kind = F.when(F.col("l_returnflag") == "A", "DEL").when(F.col("l_returnflag") == "N", "INS").otherwise("INV")
    return t.lineitem.select(
        F.col("l_orderkey").alias("contig"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("line"),
        pos.alias("pos"), size.alias("len"), (pos + size).alias("end"), kind.alias("svtype"), F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def distinct_calls(t: Tables) -> DataFrame:
    """Calls that differ in contig, svtype, status, pos or len, with the least part as id; brought together in tasks of bounded size."""
    rows, place = calls(t), ["contig", "svtype", "status", "pos", "len"]
    dealt = rows.select(*place, "part").repartition(intervals.tasks_for(rows, rows.count()), *place)
    return dealt.groupBy(*place).agg(F.min("part").alias("id"))


def taxonomy(t: Tables) -> DataFrame:
    """sample, clade (nation) and phylum (region) of each supplier."""
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sample"), F.col("n_name").alias("clade"), F.col("r_name").alias("phylum"))


_TAXONOMY = "tax AS (SELECT s_suppkey AS sample, n_name AS clade, r_name AS phylum FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
#: Ranks are looked up for counts by sample, of which there are few, not for calls.
_BY_SAMPLE = ["sample", "svtype"]


@query(f"WITH {_CALLS}, {_TAXONOMY} SELECT phylum, clade, svtype, count(*) AS n, grouping(phylum, clade, svtype) AS level FROM calls JOIN tax USING (sample) GROUP BY ROLLUP (phylum, clade, svtype)")
def calls_by_rank_rollup(t: Tables) -> DataFrame:
    """Counts at every rank from the root to clade and type."""
    counts = calls(t).groupBy(*_BY_SAMPLE).agg(F.count("*").alias("c")).join(taxonomy(t), "sample")
    return counts.rollup("phylum", "clade", "svtype").agg(F.sum("c").alias("n"), F.grouping_id().cast("long").alias("level"))


@query(f"WITH {_CALLS}, {_TAXONOMY} SELECT phylum, svtype, CASE WHEN discount >= 0.08 THEN 'integrative' WHEN discount >= 0.04 THEN 'transposable' WHEN discount > 0 THEN 'repeat' ELSE 'none' END AS category, count(*) AS n, count(DISTINCT sample) AS samples FROM calls JOIN tax USING (sample) GROUP BY ALL")
def mge_architecture(t: Tables) -> DataFrame:
    """Counts by phylum, type and mobile-element category."""
    category = F.when(F.col("discount") >= 0.08, "integrative").when(F.col("discount") >= 0.04, "transposable").when(F.col("discount") > 0, "repeat").otherwise("none")
    counts = calls(t).groupBy("sample", "svtype", category.alias("category")).agg(F.count("*").alias("c"))
    return counts.join(taxonomy(t), "sample").groupBy("phylum", "svtype", "category").agg(F.sum("c").alias("n"), F.count_distinct("sample").alias("samples"))


@query(f"WITH {_CALLS}, {_TAXONOMY} SELECT phylum, svtype, count(*) AS events, count(DISTINCT clade) AS clades FROM calls JOIN tax USING (sample) WHERE discount >= 0.05 AND len >= 40 GROUP BY ALL ORDER BY events DESC, phylum, svtype")
def hgt_propagation(t: Tables) -> DataFrame:
    """Transfer-like events by phylum and type, most first."""
    counts = calls(t).filter("discount >= 0.05 AND len >= 40").groupBy(*_BY_SAMPLE).agg(F.count("*").alias("c"))
    out = counts.join(taxonomy(t), "sample").groupBy("phylum", "svtype").agg(F.sum("c").alias("events"), F.count_distinct("clade").alias("clades"))
    return out.orderBy(F.col("events").desc(), "phylum", "svtype")


@query(
    f"""WITH {_CALLS}, g AS (SELECT DISTINCT o_orderkey, o_orderkey % 1000 AS contig, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS gs FROM orders),
    c AS (SELECT contig % 1000 AS contig, part, line, pos, "end" FROM calls WHERE svtype = 'INV' AND status = 'F')
    SELECT o_orderkey AS gene, count(*) AS hits, min(pos) AS first_pos FROM c JOIN g ON c.contig = g.contig AND g.gs <= c."end" + 5 AND g.gs + 20 >= c.pos - 5 GROUP BY o_orderkey"""
)
def interval_overlap_join(t: Tables) -> DataFrame:
    """Calls within 5 of each gene, by a bin join."""
    c = calls(t).filter("svtype = 'INV' AND status = 'F'").select((F.col("contig") % 1000).alias("contig"), "pos", "end")
    g = _genes(t)
    near = intervals.overlap_join(c, g, "contig", ("pos", "end"), ("gs", "ge"), 100, 5)
    return near.groupBy("gene").agg(F.count("*").alias("hits"), F.min("pos").alias("first_pos"))


def _genes(t: Tables) -> DataFrame:
    start = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long")
    return t.orders.select(F.col("o_orderkey").alias("gene"), (F.col("o_orderkey") % 1000).alias("contig"), start.alias("gs"), (start + 20).alias("ge"))


@query(
    f"""WITH {_CALLS}, m AS (SELECT contig, pos, "end", max("end") OVER (PARTITION BY contig ORDER BY pos, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM calls),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR pos > before THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT contig, min(pos) AS pos, max("end") AS "end", count(*) AS n FROM i GROUP BY contig, island"""
)
def interval_merge_islands(t: Tables) -> DataFrame:
    """Islands of overlapping calls."""
    return intervals.merged(calls(t).select("contig", "pos", "end"), ["contig"], "pos", "end")


@query(
    f"""WITH {_CALLS}, p AS (SELECT DISTINCT o_orderkey % 1000 AS contig, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS place FROM orders),
    s AS (SELECT contig % 1000 AS contig, pos, "end" FROM calls WHERE svtype = 'DEL')
    SELECT p.contig, place, count(s.pos) AS stabbed FROM p LEFT JOIN s ON p.contig = s.contig AND s.pos <= place AND s."end" >= place GROUP BY ALL"""
)
def stab_count(t: Tables) -> DataFrame:
    """How many deletions hold each point; running sums of begun and ended intervals."""
    spans = calls(t).filter("svtype = 'DEL'").select((F.col("contig") % 1000).alias("contig"), "pos", "end")
    points = t.orders.select((F.col("o_orderkey") % 1000).alias("contig"), F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long").alias("place"))
    return intervals.stab_counts(points, spans, "contig", "place", "pos", "end")


@query(
    f"""WITH {_CALLS}, g AS (SELECT o_orderkey AS gene, o_orderkey % 1000 AS contig, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS gs FROM orders),
    p AS (SELECT DISTINCT contig % 1000 AS contig, pos FROM calls WHERE status = 'F')
    SELECT p.contig, pos, min(greatest(0, gs - pos, pos - (gs + 20))) AS distance FROM p JOIN g USING (contig) GROUP BY ALL"""
)
def nearest_gene_distance(t: Tables) -> DataFrame:
    """The distance from each call to the nearest gene of its contig, in one sorted pass."""
    p = calls(t).filter("status = 'F'").select((F.col("contig") % 1000).alias("contig"), "pos")
    found = intervals.nearest(p, _genes(t), "contig", "pos", "gs", "ge", "gene")
    return found.filter("distance IS NOT NULL").select("contig", "pos", "distance")


@query(
    f"""WITH {_CALLS}, k AS (SELECT sample, svtype, count(*) AS total, count(*) FILTER (WHERE status = 'F') AS yes FROM calls GROUP BY ALL)
    SELECT sample, svtype, total, yes, round(yes / total, 6) AS rate,
      round(greatest(0, (yes / total + 1.96 * 1.96 / (2 * total) - 1.96 * sqrt(yes / total * (1 - yes / total) / total + 1.96 * 1.96 / (4 * total * total))) / (1 + 1.96 * 1.96 / total)), 6) AS lo,
      round(least(1, (yes / total + 1.96 * 1.96 / (2 * total) + 1.96 * sqrt(yes / total * (1 - yes / total) / total + 1.96 * 1.96 / (4 * total * total))) / (1 + 1.96 * 1.96 / total)), 6) AS hi FROM k"""
)
def read_validation_wilson(t: Tables) -> DataFrame:
    """Validated calls, their rate and Wilson interval, by sample and type."""
    k = calls(t).groupBy("sample", "svtype").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "F").alias("yes"))
    low, high = S.wilson(F.col("yes"), F.col("total"))
    return k.select("*", F.round(F.col("yes") / F.col("total"), 6).alias("rate"), F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"))


@query(
    f"""WITH {_CALLS}, k AS (SELECT coalesce(sample::VARCHAR, 'ALL') AS query, count(*) AS total, count(*) FILTER (WHERE status = 'F') AS yes FROM calls GROUP BY GROUPING SETS ((sample), ()))
    SELECT query, total, yes, CASE WHEN total < 20 THEN 'insufficient' WHEN yes / total < 0.45 THEN 'below' WHEN yes / total > 0.55 THEN 'above' ELSE 'in' END AS gate FROM k"""
)
def claim_gates_pooled(t: Tables) -> DataFrame:
    """Whether each sample's rate lies in the claimed band, with a pooled row."""
    k = calls(t).withColumn("query", F.col("sample").cast("string")).groupBy("query").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "F").alias("yes"))
    pooled = k.rollup("query").agg(F.sum("total").alias("total"), F.sum("yes").alias("yes")).withColumn("query", F.coalesce("query", F.lit("ALL")))
    rate = F.col("yes") / F.col("total")
    gate = F.when(F.col("total") < 20, "insufficient").when(rate < 0.45, "below").when(rate > 0.55, "above").otherwise("in")
    return pooled.withColumn("gate", gate)


@query(
    f"""WITH {_CALLS}, l AS (SELECT contig % 500 AS contig, svtype, pos // 50 AS locus, count(DISTINCT sample) AS strains FROM calls GROUP BY ALL)
    SELECT svtype, strains, count(*) AS loci, CASE WHEN strains = 1 THEN 'singleton' WHEN strains >= greatest(1, floor(0.9 * 100)) THEN 'near_fixed' ELSE 'intermediate' END AS class FROM l GROUP BY svtype, strains"""
)
def site_frequency_spectrum(t: Tables) -> DataFrame:
    """Loci by the number of strains that have them."""
    loci = calls(t).select((F.col("contig") % 500).alias("contig"), "svtype", F.floor(F.col("pos") / 50).alias("locus"), "sample").groupBy("contig", "svtype", "locus").agg(F.count_distinct("sample").alias("strains"))
    kind = F.when(F.col("strains") == 1, "singleton").when(F.col("strains") >= 90, "near_fixed").otherwise("intermediate")
    return loci.groupBy("svtype", "strains").agg(F.count("*").alias("loci")).withColumn("class", kind)


@query(
    f"""WITH {_CALLS} SELECT contig % 200 AS contig, pos // 500 AS locus, {', '.join(f"max(CASE WHEN sample % 5 = {k} THEN 1 ELSE 0 END) AS s{k}" for k in range(5))} FROM calls GROUP BY ALL"""
)
def occupancy_pivot(t: Tables) -> DataFrame:
    """Locus by strain group, one 0/1 column each."""
    rows = calls(t).select((F.col("contig") % 200).alias("contig"), F.floor(F.col("pos") / 500).alias("locus"), F.concat(F.lit("s"), (F.col("sample") % 5).cast("string")).alias("strain"))
    wide = rows.groupBy("contig", "locus").pivot("strain", [f"s{k}" for k in range(5)]).agg(F.max(F.lit(1)))
    return wide.na.fill(0)


@query(
    f"""WITH {_CALLS} SELECT sample, svtype, max(CASE WHEN contig % 3 = 0 THEN CASE WHEN status = 'F' THEN '1/1' ELSE '0/1' END ELSE NULL END) AS gt0,
      max(CASE WHEN contig % 3 = 1 THEN CASE WHEN status = 'F' THEN '1/1' ELSE '0/1' END ELSE NULL END) AS gt1 FROM calls GROUP BY ALL"""
)
def multisample_pivot(t: Tables) -> DataFrame:
    """Genotype columns by sample group."""
    rows = calls(t).select("sample", "svtype", F.concat(F.lit("gt"), (F.col("contig") % 3).cast("string")).alias("g"), F.when(F.col("status") == "F", "1/1").otherwise("0/1").alias("gt"))
    return rows.groupBy("sample", "svtype").pivot("g", ["gt0", "gt1"]).agg(F.max("gt"))


_ORDER = "price DESC, contig, part, sample, line, pos"


def _by_price() -> list:
    return [F.col("price").desc(), F.col("contig"), F.col("part"), F.col("sample"), F.col("line"), F.col("pos")]


@query(
    f"""WITH {_CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY svtype ORDER BY {_ORDER}) AS own FROM calls),
    s AS (SELECT *, CASE WHEN own <= greatest(3, least(25, 100 // (2 * (SELECT count(DISTINCT svtype) FROM calls)))) THEN 0 ELSE 1 END AS late FROM r WHERE own <= 100)
    SELECT contig, part, sample, line, pos, svtype, price FROM s ORDER BY late, {_ORDER} LIMIT 100"""
)
def quota_diverse_topn(t: Tables) -> DataFrame:
    """A diverse top hundred: a quota of each type, then the best of the rest."""
    return selection.quota_then_rank(calls(t), "svtype", _by_price(), 100).select("contig", "part", "sample", "line", "pos", "svtype", "price")


@query(
    f"""WITH {_CALLS}, r AS (SELECT contig % 50 AS bucket, *, row_number() OVER (PARTITION BY contig % 50, sample ORDER BY {_ORDER}) AS own FROM calls),
    s AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN own <= 3 THEN 0 ELSE 1 END, {_ORDER}) AS k FROM r)
    SELECT bucket, contig, part, sample, line, pos, price FROM s WHERE k <= 40"""
)
def per_asm_reserved_topn(t: Tables) -> DataFrame:
    """Up to three calls of each assembly first, then the best, forty a bucket."""
    rows = calls(t).withColumn("bucket", F.col("contig") % 50)
    return selection.reserved_then_rank(rows, ["bucket"], "sample", _by_price(), 3, 40).select("bucket", "contig", "part", "sample", "line", "pos", "price")


@query(
    f"""WITH {_CALLS} SELECT contig, pos, svtype, len // 10 AS len_bin, max(price) AS best_price, count(*) AS merged FROM calls GROUP BY ALL"""
)
def multirank_dedup(t: Tables) -> DataFrame:
    """Calls of several ranks at one place become the one with the best score."""
    return calls(t).groupBy("contig", "pos", "svtype", F.floor(F.col("len") / 10).alias("len_bin")).agg(F.max("price").alias("best_price"), F.count("*").alias("merged"))


@query(
    f"""WITH {_CALLS} SELECT sample, contig, part, line, pos, len FROM calls WHERE svtype = 'INS'
    QUALIFY row_number() OVER (PARTITION BY sample ORDER BY CASE WHEN discount >= 0.05 THEN 0 ELSE 1 END, len DESC, {_ORDER}) = 1"""
)
def offref_collapse(t: Tables) -> DataFrame:
    """One off-reference call a query: diverged ones first, then the longest."""
    order = [F.when(F.col("discount") >= 0.05, 0).otherwise(1), F.col("len").desc(), *_by_price()]
    return selection.top_per_key(calls(t).filter("svtype = 'INS'"), ["sample"], order).select("sample", "contig", "part", "line", "pos", "len")


@query(
    f"""WITH {_CALLS}, b AS (SELECT contig, svtype, pos, len, pos + len AS e, max(pos + len) OVER (PARTITION BY contig, svtype ORDER BY pos, len DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM calls),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR pos - before > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, svtype ORDER BY pos, len DESC ROWS UNBOUNDED PRECEDING) AS island FROM b)
    SELECT contig, svtype, min(pos) AS pos, max(e) AS "end", max(len) AS len, count(*) AS n FROM i GROUP BY contig, svtype, island"""
)
def adjacent_event_merge(t: Tables) -> DataFrame:
    """Events of a type within 80 of each other become one."""
    return selection.run_merge(calls(t).select("contig", "svtype", "pos", "len"), ["contig", "svtype"], "pos", "len", 80).select("contig", "svtype", "pos", "end", "len", "n")


@query(
    f"""WITH {_CALLS}, e AS (SELECT sample, svtype, count(*) AS n,
      sum((CASE WHEN status = 'F' THEN 0.70 + 0.30 * greatest(0.8, 1 - discount) ELSE 0.55 + 0.45 * (0.6 * 0.8 + 0.4 * (1 - discount)) END) * ln(1 + line) * (tax - discount)) AS w FROM calls GROUP BY ALL)
    SELECT sample, svtype, n, round(ln(0.2 / 0.8) + w, 6) AS logodds, round(1 / (1 + exp(-(ln(0.2 / 0.8) + w))), 6) AS posterior FROM e"""
)
def evidence_fusion(t: Tables) -> DataFrame:
    """Posterior log-odds from all layers of a sample's evidence."""
    layer = F.when(F.col("status") == "F", "ASM").otherwise("LR")
    agreement = 1 - F.col("discount")
    weight = S.evidence_weight(layer, F.col("line"), F.col("tax"), F.col("discount"), F.lit(48.0), agreement, agreement)
    e = calls(t).groupBy("sample", "svtype").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    odds = F.log(F.lit(0.2) / 0.8) + F.col("w")
    return e.select("sample", "svtype", "n", F.round(odds, 6).alias("logodds"), F.round(S.sigmoid(odds), 6).alias("posterior"))


@query(
    f"""WITH {_CALLS}, a AS (SELECT sample, count(*) FILTER (WHERE status = 'F') AS alt, count(*) FILTER (WHERE status <> 'F') AS ref FROM calls GROUP BY sample),
    c AS (SELECT *, (ref + 1) / (sqrt(alt * alt + ref * ref + 1) * sqrt(2)) AS hom_ref, (alt + ref + 1) / (sqrt(alt * alt + ref * ref + 1) * sqrt(3)) AS het, (alt + 1) / (sqrt(alt * alt + ref * ref + 1) * sqrt(2)) AS hom_alt FROM a)
    SELECT sample, alt, ref, CASE WHEN het >= greatest(hom_ref, hom_alt) THEN '0/1' WHEN hom_alt >= hom_ref THEN '1/1' ELSE '0/0' END AS genotype FROM c"""
)
def cosine_genotype(t: Tables) -> DataFrame:
    """Genotypes by the best cosine with templates."""
    a = calls(t).groupBy("sample").agg(F.count_if(F.col("status") == "F").alias("alt"), F.count_if(F.col("status") != "F").alias("ref"))
    genotype, _ = S.cosine_genotype(F.col("alt"), F.col("ref"), F.lit(1.0))
    return a.select("*", genotype.alias("genotype"))


@query(
    f"""WITH {_CALLS}, k AS (SELECT contig, part, line, sample, pos, price, discount, tax, round(40 + 180 * discount + 0.20 * least(400, len) + 2 * least(80, line) + 120 * tax + 12 * greatest(-6, least(12, tax - discount))
      - CASE WHEN tax < 0.35 THEN 120 ELSE 0 END + 8 + 4 * least(4, line) + 2 * least(8, line) + 0.30 * 50 + 0.20 * 40, 6) AS priority FROM calls)
    SELECT contig, part, line, sample, pos, priority FROM k QUALIFY row_number() OVER (PARTITION BY contig ORDER BY priority DESC, part, line, sample, pos, price, discount, tax) = 1"""
)
def priority_score(t: Tables) -> DataFrame:
    """The candidate of highest priority of each contig."""
    c = {"off_ref": F.lit(False), "overlap": F.col("discount"), "score": F.col("len"), "anchors": F.col("line"), "mapq": F.lit(50), "gq": F.lit(40), "posterior": F.col("tax"), "logodds": F.col("tax") - F.col("discount"), "depth": F.col("line"), "layers": F.col("line"), "mode": F.lit("mem_chain"), "svtype": F.col("svtype")}
    rows = calls(t).withColumn("priority", F.round(priority(c), 6))
    order = [F.col("priority").desc(), *(F.col(x) for x in ("part", "line", "sample", "pos", "price", "discount", "tax"))]
    return selection.top_per_key(rows, ["contig"], order).select("contig", "part", "line", "sample", "pos", "priority")


@query(
    f"""WITH {_CALLS}, x AS (SELECT DISTINCT contig, svtype, pos // 30 AS bin, status FROM calls),
    m AS (SELECT contig, svtype, bin, bool_or(status = 'O') AS t, bool_or(status = 'F') AS p FROM x GROUP BY ALL),
    s AS (SELECT svtype, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM m GROUP BY svtype)
    SELECT coalesce(svtype, 'ALL') AS svtype, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
      round(CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0 END, 6) AS "precision", round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0 END, 6) AS recall,
      round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0 END, 6) AS f1 FROM s GROUP BY GROUPING SETS ((svtype), ())"""
)
def pr_by_type(t: Tables) -> DataFrame:
    """Precision, recall and F1 by type and over all, on exact locus keys."""
    m = calls(t).groupBy("contig", "svtype", F.floor(F.col("pos") / 30).alias("bin")).agg(F.bool_or(F.col("status") == "O").alias("t"), F.bool_or(F.col("status") == "F").alias("p"))
    s = m.groupBy("svtype").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(F.col("p") & ~F.col("t")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    a = s.rollup("svtype").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn("svtype", F.coalesce("svtype", F.lit("ALL")))
    precision, recall = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(S.f1(precision, recall), 6).alias("f1"))


@query(
    f"""WITH {_CALLS}, k AS (SELECT contig % 300 AS contig, svtype, pos // 200 AS bin, count(DISTINCT sample % 4) AS callers, count(*) AS n FROM calls GROUP BY ALL)
    SELECT svtype, callers, count(*) AS loci, sum(n)::BIGINT AS calls FROM k WHERE callers >= 2 GROUP BY ALL"""
)
def consensus_support(t: Tables) -> DataFrame:
    """Loci that at least two callers support."""
    k = calls(t).groupBy((F.col("contig") % 300).alias("contig"), "svtype", F.floor(F.col("pos") / 200).alias("bin")).agg(F.count_distinct(F.col("sample") % 4).alias("callers"), F.count("*").alias("n"))
    return k.filter("callers >= 2").groupBy("svtype", "callers").agg(F.count("*").alias("loci"), F.sum("n").alias("calls"))


@query()
def greedy_match_tolerance(t: Tables) -> DataFrame:
    """One-to-one matches of predicted to true calls, nearest first (tested against brute force)."""
    rows = distinct_calls(t)
    truth, found = rows.filter("status = 'O'"), rows.filter("status = 'F'")
    return selection.greedy_match(truth, found, ["contig", "svtype"], 400, 10.0)


@query()
def nonoverlap_selection(t: Tables) -> DataFrame:
    """Greedy choice by score of calls that keep their distance (tested against brute force)."""
    rows = calls(t).select("contig", "svtype", "pos", "end", "price", "part", "line")
    return selection.non_overlapping(rows, ["contig", "svtype"], "pos", "end", "price", 20)


@query()
def greedy_cluster_inversions(t: Tables) -> DataFrame:
    """Clusters of inversions by distance to a cluster's first member (tested against brute force)."""
    rows = calls(t).filter("svtype = 'INV'").select((F.col("contig") % 300).alias("contig"), "pos", "part", "line")
    return selection.greedy_clusters(rows, ["contig"], "pos", 30)


@query(f"WITH {_CALLS} SELECT contig % 20 AS contig, pos // 25 * 25 AS bin_start, count(*) AS n FROM calls GROUP BY ALL")
def density_bins(t: Tables) -> DataFrame:
    """Calls by bins of 25."""
    return intervals.density(calls(t).withColumn("contig", F.col("contig") % 20), ["contig"], "pos", 25)


@query(f"WITH {_CALLS} SELECT contig % 20 AS contig, pos // 50 * 50 AS bin_start, count(*) FILTER (WHERE discount >= 0.05) AS te, count(*) FILTER (WHERE discount < 0.05) AS other FROM calls GROUP BY ALL")
def two_speed_bins(t: Tables) -> DataFrame:
    """Mobile elements against other calls by bin."""
    te = F.col("discount") >= 0.05
    return calls(t).groupBy((F.col("contig") % 20).alias("contig"), (F.floor(F.col("pos") / 50) * 50).alias("bin_start")).agg(F.count_if(te).alias("te"), F.count_if(~te).alias("other"))


@query(f"""WITH {_CALLS} SELECT svtype, CASE WHEN len * 300 <= 50 THEN '0-50' WHEN len * 300 <= 100 THEN '51-100' WHEN len * 300 <= 500 THEN '101-500' WHEN len * 300 <= 1000 THEN '501-1000' WHEN len * 300 <= 10000 THEN '1001-10000'
    WHEN len * 300 <= 100000 THEN '10001-100000' ELSE '>100000' END AS bin, count(*) AS n FROM calls GROUP BY ALL""")
def size_bins(t: Tables) -> DataFrame:
    """Calls by type and size."""
    return calls(t).groupBy("svtype", S.size_bin(F.col("len") * 300).alias("bin")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_CALLS}, s AS (SELECT contig, string_agg(DISTINCT svtype, ';' ORDER BY svtype) AS members FROM calls GROUP BY contig) SELECT members, count(*) AS n FROM s GROUP BY members"""
)
def upset_memberships(t: Tables) -> DataFrame:
    """Cardinalities of the sets of types that contigs have."""
    s = calls(t).groupBy("contig").agg(F.array_join(F.array_sort(F.collect_set("svtype")), ";").alias("members"))
    return s.groupBy("members").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_CALLS} SELECT contig, sum(len)::BIGINT AS span, max(gap) AS largest_gap, count(*) FILTER (WHERE gap >= 40) AS gaps
    FROM (SELECT *, pos - lag("end") OVER (PARTITION BY contig ORDER BY pos, "end", part, line) AS gap FROM calls) GROUP BY contig"""
)
def chain_gap_events(t: Tables) -> DataFrame:
    """Gaps between consecutive calls of a contig."""
    order = Window.partitionBy("contig").orderBy("pos", "end", "part", "line")
    rows = calls(t).withColumn("gap", F.col("pos") - F.lag("end").over(order))
    return rows.groupBy("contig").agg(F.sum("len").alias("span"), F.max("gap").alias("largest_gap"), F.count_if(F.col("gap") >= 40).alias("gaps"))


@query(
    f"""WITH {_CALLS}, b AS (SELECT sample, svtype, quantile_disc(len, 0.5) AS median_len, quantile_cont(len, 0.5) AS middle_len FROM calls GROUP BY ALL) SELECT sample, svtype, median_len, round(middle_len, 6) AS middle_len FROM b"""
)
def median_lengths(t: Tables) -> DataFrame:
    """Exact medians of call lengths."""
    return calls(t).groupBy("sample", "svtype").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY len)").cast("long").alias("median_len"), F.round(F.percentile("len", F.lit(0.5)), 6).alias("middle_len"))


@query(
    f"""WITH {_CALLS}, n AS (SELECT sample, quantile_disc(len, 0.5) AS n50 FROM calls GROUP BY sample)
    SELECT sample, count(*) AS kept, count(*) FILTER (WHERE svtype = 'INV') AS kept_inv FROM calls JOIN n USING (sample) WHERE NOT (svtype = 'INV' AND len > 1.5 * n50 AND line < 5) GROUP BY sample"""
)
def oversized_read_gate(t: Tables) -> DataFrame:
    """Drops inversions far longer than the reads that have few anchors."""
    rows = calls(t)
    n = rows.groupBy("sample").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY len)").alias("n50"))
    kept = rows.join(n, "sample").filter(~((F.col("svtype") == "INV") & (F.col("len") > 1.5 * F.col("n50")) & (F.col("line") < 5)))
    return kept.groupBy("sample").agg(F.count("*").alias("kept"), F.count_if(F.col("svtype") == "INV").alias("kept_inv"))


@query(
    f"""WITH {_CALLS}, s AS (SELECT sample, svtype, count(*) AS n, avg(ln(greatest(0, price) + 1) / ln(2)) AS m, CASE WHEN count(*) < 2 THEN 0 ELSE var_samp(ln(greatest(0, price) + 1) / ln(2)) END AS v FROM calls GROUP BY ALL)
    SELECT a.sample, a.svtype AS low, b.svtype AS high, round(b.m - a.m, 6) AS fold, round(a.v, 6) AS v_low, round(b.v, 6) AS v_high FROM s a JOIN s b ON a.sample = b.sample AND a.svtype < b.svtype WHERE a.n >= 2 AND b.n >= 2"""
)
def expression_contrasts(t: Tables) -> DataFrame:
    """log2 fold changes between the condition pairs of each sample; pairs are of three conditions, never of rows."""
    x = F.log2(F.greatest(F.lit(0.0), F.col("price")) + 1)
    s = calls(t).groupBy("sample", "svtype").agg(F.count("*").alias("n"), F.avg(x).alias("m"), stats.sample_variance(x).alias("v")).filter("n >= 2")
    b = s.select("sample", F.col("svtype").alias("high"), F.col("m").alias("m2"), F.col("v").alias("v2"))
    both = s.join(b, "sample").filter(F.col("svtype") < F.col("high"))
    return both.select("sample", F.col("svtype").alias("low"), "high", F.round(F.col("m2") - F.col("m"), 6).alias("fold"), F.round("v", 6).alias("v_low"), F.round("v2", 6).alias("v_high"))
