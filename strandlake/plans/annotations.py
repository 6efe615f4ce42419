"""Queries over names, attributes and rules: pages, parts, customers, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import scores as S
from strandlake.operators import lookup
from strandlake.plans.registry import Tables, query


@query(
    """WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?(.*)$', 1), '&')) AS kv FROM pages WHERE contains(url, '?'))
    SELECT regexp_extract(kv, '^([^=]*)', 1) AS key, count(*) AS n, count(DISTINCT CASE WHEN contains(kv, '=') THEN regexp_replace(kv, '^[^=]*=', '') ELSE '1' END) AS n_values FROM q WHERE kv <> '' GROUP BY 1"""
)
def info_parse_map(t: Tables) -> DataFrame:
    """KEY=VALUE attributes of urls: counts and distinct values by key."""
    info = F.replace(F.regexp_extract("url", r"\?(.*)$", 1), F.lit("&"), F.lit(";"))
    entries = F.filter(F.split(info, ";"), lambda p: p != "")
    rows = t.pages.filter(F.contains("url", F.lit("?"))).select(F.explode(entries).alias("kv"))
    key, value = F.substring_index("kv", "=", 1), F.when(F.contains("kv", F.lit("=")), F.regexp_replace("kv", "^[^=]*=", "")).otherwise("1")
    return rows.select(key.alias("key"), value.alias("v")).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("v").alias("n_values"))


@query(
    """WITH c AS (SELECT c_custkey, 'GCA_' || c_custkey || '.1' AS acc, c_name FROM customer),
    r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'x/' || c_name || '.fasta' ELSE c_name || '.fa.gz' END AS name FROM orders JOIN customer ON o_custkey = c_custkey),
    a AS (SELECT o_orderkey, unnest([{r: 0, a: name}, {r: 1, a: regexp_replace(name, '\\.(fa|fasta|fna)(\\.gz)?$', '')}, {r: 2, a: regexp_replace(regexp_replace(name, '\\.(fa|fasta|fna)(\\.gz)?$', ''), '[._]\\d+$', '')},
        {r: 4, a: regexp_replace(regexp_replace(name, '\\.(fa|fasta|fna)(\\.gz)?$', ''), '^.*/', '')}]) AS x FROM r)
    SELECT o_orderkey, arg_min(c_custkey, x.r) AS c_custkey FROM a JOIN customer ON x.a = c_name GROUP BY o_orderkey"""
)
def alias_first_hit_join(t: Tables) -> DataFrame:
    """Samples under several spellings meet their records by the first alias that hits."""
    c = t.customer.select("c_custkey", "c_name")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.col("c_name")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("x/"), "c_name", F.lit(".fasta"))).otherwise(F.concat("c_name", F.lit(".fa.gz")))
    rows = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", name.alias("name"))
    return lookup.alias_join(rows, c, lookup.name_aliases(F.col("name")), "c_name", ["o_orderkey"]).filter("alias_rank IS NOT NULL").select("o_orderkey", "c_custkey")


@query(
    """WITH n AS (SELECT DISTINCT p_type || '_' || p_size || '_' || (p_partkey % 7) AS name FROM part), o AS (SELECT DISTINCT p_type AS owner FROM part UNION SELECT DISTINCT p_type || '_' || p_size FROM part WHERE p_size % 2 = 0)
    SELECT name, arg_max(owner, length(owner)) AS owner FROM n JOIN o ON name = owner OR starts_with(name, owner || '_') GROUP BY name"""
)
def prefix_owner_join(t: Tables) -> DataFrame:
    """The owner of a name by its longest prefix."""
    names = t.part.select(F.concat_ws("_", "p_type", "p_size", F.col("p_partkey") % 7).alias("name")).distinct()
    owners = t.part.select(F.col("p_type").alias("owner")).union(t.part.filter("p_size % 2 = 0").select(F.concat_ws("_", "p_type", "p_size")))
    return lookup.prefix_owner(names, owners, "name", "owner")


@query(
    """WITH g AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN '.' ELSE 'asm' || (s_suppkey % 4) END AS asm, s_nationkey AS contig, max(s_acctbal) AS value FROM supplier GROUP BY ALL),
    c AS (SELECT c_custkey, 'asm' || (c_custkey % 5) AS asm, c_nationkey AS contig FROM customer)
    SELECT c_custkey, coalesce(o.value, w.value) AS value FROM c LEFT JOIN g o ON o.asm = c.asm AND o.contig = c.contig LEFT JOIN g w ON w.asm = '.' AND w.contig = c.contig"""
)
def wildcard_fallback_join(t: Tables) -> DataFrame:
    """A value of assembly and contig, else that of the wildcard assembly."""
    asm = F.when(F.col("s_suppkey") % 4 == 0, ".").otherwise(F.concat(F.lit("asm"), (F.col("s_suppkey") % 4).cast("string")))
    g = t.supplier.groupBy(asm.alias("asm"), F.col("s_nationkey").alias("contig")).agg(F.max("s_acctbal").alias("value"))
    c = t.customer.select("c_custkey", F.concat(F.lit("asm"), (F.col("c_custkey") % 5).cast("string")).alias("asm"), F.col("c_nationkey").alias("contig"))
    return lookup.wildcard_join(c, g, "asm", "contig", "value").select("c_custkey", "value")


@query(
    """WITH f AS (SELECT p_partkey, p_size % 5 = 0 AS hgt, p_size % 3 = 0 AS switch, p_retailprice > 950 AS expr, p_type IN ('ECONOMY', 'STANDARD') AS te, p_partkey % 4 = 0 AS novel,
      CASE p_partkey % 3 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'OTHER' END AS svtype FROM part),
    k AS (SELECT CASE WHEN hgt AND switch THEN 'hgt_clade_switch' WHEN hgt THEN 'hgt_candidate' WHEN expr AND te AND switch THEN 'te_expression_switch' WHEN expr AND te THEN 'te_expression_link' WHEN te AND novel THEN 'novel_te_architecture'
      WHEN switch AND te THEN 'te_clade_switch' WHEN switch THEN 'clade_switch' WHEN te AND svtype <> 'OTHER' THEN 'te_structural' WHEN novel THEN 'novel_sequence' WHEN svtype <> 'OTHER' THEN 'structural' ELSE 'other' END AS class FROM f)
    SELECT class, count(*) AS n FROM k GROUP BY class"""
)
def candidate_ladder(t: Tables) -> DataFrame:
    """Candidates by the first rule of the priority ladder that holds."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "INS").when(F.col("p_partkey") % 3 == 1, "DEL").otherwise("OTHER")
    name, _ = lookup.candidate_class(F.col("p_size") % 5 == 0, F.col("p_size") % 3 == 0, F.col("p_retailprice") > 950, F.col("p_type").isin("ECONOMY", "STANDARD"), F.col("p_partkey") % 4 == 0, kind)
    return t.part.select(name.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query(
    """WITH r(rule, word, weight) AS (VALUES (1, 'small', 2), (2, 'red', 3), (3, 'ring', 3), (4, 'widget', 1)),
    s AS (SELECT p_partkey, rule, CASE WHEN contains(p_name, word) THEN weight ELSE 0 END AS score FROM part CROSS JOIN r),
    b AS (SELECT p_partkey, max(score) AS score, arg_max(rule, score * 10 - rule) AS rule FROM s GROUP BY p_partkey) SELECT CASE WHEN score > 0 THEN rule ELSE 0 END AS rule, score, count(*) AS n FROM b GROUP BY ALL"""
)
def functional_example_rules(t: Tables) -> DataFrame:
    """The best of a few fixed templates for each part."""
    rules = t.spark.createDataFrame([(1, "small", 2), (2, "red", 3), (3, "ring", 3), (4, "widget", 1)], "rule int, word string, weight int")
    best = lookup.best_rule(t.part.select("p_partkey", "p_name"), rules, ["p_partkey"], F.contains("p_name", F.col("word")), F.col("weight"))
    return best.groupBy(F.coalesce("rule", F.lit(0)).alias("rule"), F.col("rule_score").alias("score")).agg(F.count("*").alias("n"))


@query(
    """SELECT CASE WHEN p_brand = 'Brand#1' THEN 'lichen' WHEN p_brand = 'Brand#2' THEN 'yeast' WHEN p_name LIKE '%red%' THEN 'pathogen' WHEN p_name LIKE '%small%' THEN 'mutualist' ELSE 'unknown' END AS guild,
    count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY ALL"""
)
def guild_fold(t: Tables) -> DataFrame:
    """Guilds by genus, else by words."""
    words = F.when(F.contains("p_name", F.lit("red")), "parasite").when(F.contains("p_name", F.lit("small")), "symbiont").otherwise("")
    kind = lookup.guild(F.col("p_brand"), words, {"Brand#1": "lichen", "Brand#2": "yeast"})
    return t.part.groupBy(kind.alias("guild")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query(
    """WITH w AS (SELECT DISTINCT p_partkey, p_type, unnest(list_concat(string_split(p_name, ' '), [lower(p_type)])) AS token FROM part) SELECT token, p_type, count(*) AS n FROM w GROUP BY ALL"""
)
def ecology_tokens(t: Tables) -> DataFrame:
    """A contingency table of the tokens of two columns against a label."""
    tokens = F.array_union(F.split("p_name", " "), F.array(F.lower("p_type")))
    return t.part.select("p_type", F.explode(tokens).alias("token")).groupBy("token", "p_type").agg(F.count("*").alias("n"))


@query(
    """SELECT c_mktsegment AS segment, count(*) AS n, count(CASE WHEN upper(trim(v)) NOT IN ('', '.', 'NA', 'NONE') THEN 1 END) AS known FROM (SELECT c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN ' . ' ELSE c_name END AS v FROM customer) GROUP BY 1"""
)
def null_label_mask(t: Tables) -> DataFrame:
    """How many labels say something."""
    v = F.when(F.col("c_custkey") % 4 == 0, "none").when(F.col("c_custkey") % 4 == 1, " . ").otherwise(F.col("c_name"))
    return t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count(S.masked(v)).alias("known"))


@query(
    """WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT p_type, p_brand, n, avg(n) OVER (PARTITION BY p_type) AS m, stddev_pop(n) OVER (PARTITION BY p_type) AS d, sum(n) OVER (PARTITION BY p_type) AS total FROM c)
    SELECT p_type AS class, p_brand AS trait, n, round(CASE WHEN d > 0 THEN (n - m) / d ELSE 0 END, 6) AS z FROM s WHERE total >= 5"""
)
def z_scaled_matrix(t: Tables) -> DataFrame:
    """Counts of class and trait as row z-scores, in long form."""
    w = Window.partitionBy("class")
    c = t.part.groupBy(F.col("p_type").alias("class"), F.col("p_brand").alias("trait")).agg(F.count("*").alias("n"))
    s = c.withColumn("m", F.avg("n").over(w)).withColumn("d", F.stddev_pop("n").over(w)).withColumn("total", F.sum("n").over(w)).filter("total >= 5")
    return s.select("class", "trait", "n", F.round(F.when(F.col("d") > 0, (F.col("n") - F.col("m")) / F.col("d")).otherwise(0.0), 6).alias("z"))


@query(
    """SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, min(o_orderdate)::DATE AS first_day FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())"""
)
def metadata_grouping_sets(t: Tables) -> DataFrame:
    """Order metadata at three levels."""
    rows = t.orders.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice", F.to_date("o_orderdate").alias("day"))
    sets = [[F.col("priority"), F.col("status")], [F.col("priority")], []]
    return rows.groupingSets(sets, F.col("priority"), F.col("status")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.min("day").alias("first_day"))


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)"""
)
def unmatched_truth(t: Tables) -> DataFrame:
    """Semi and anti joins: truth without a counterpart that still has support."""
    reversed_ = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey")
    large = t.lineitem.filter("l_quantity >= 45").select("l_orderkey")
    on = F.col("o_orderkey") == F.col("l_orderkey")
    return t.orders.select("o_orderkey", "o_custkey").join(reversed_, on, "left_anti").join(large, on, "left_semi")
