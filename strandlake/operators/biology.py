"""Findings and their biology: ecological traits and context, findings against comparators, combined tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.evaluation import locus_key
from strandlake.operators.lookup import alias_join, name_aliases
from strandlake.operators.selection import top_per_key

#: Taxa whose members live in arbuscular mycorrhiza, by genus and above it.
AMF_GENERA = (
    "acaulospora", "ambispora", "archaeospora", "cetraspora", "claroideoglomus", "dentiscutata", "diversispora", "entrophospora", "funneliformis", "gigaspora", "glomus",
    "pacispora", "paraglomus", "racocetra", "redeckera", "rhizophagus", "sclerocystis", "scutellospora", "septoglomus",
)
AMF_HIGHER = (
    "acaulosporaceae", "ambisporaceae", "archaeosporaceae", "archaeosporales", "claroideoglomeraceae", "diversisporaceae", "diversisporales", "gigasporaceae", "glomeraceae",
    "glomerales", "glomeromycetes", "glomeromycota", "glomeromycotina", "paraglomeraceae", "paraglomerales",
)
#: Other taxa with a known way of life.
PLANT_PATHOGENS = ("fusarium", "leptosphaeria", "mycosarcoma", "puccinia", "pyricularia", "ustilago", "zymoseptoria")
OPPORTUNISTS = ("candida", "cryptococcus", "nakaseomyces")
YEASTS = ("eremothecium", "hanseniaspora", "kluyveromyces", "komagataella", "lachancea", "ogataea", "pichia", "saccharomyces", "torulaspora", "yarrowia", "zygosaccharomyces")
WOOD_DECAY = ("agaricales", "polyporales", "russulales")
#: Trait names and the columns they fill.
TRAITS = {"trophic_mode_fg": ("primary_lifestyle", "trophic_mode"), "substrate": ("substrate_or_host",), "growth_form": ("growth_form",), "fruitbody_type": ("fruitbody_type",), "guild": ("guild",)}


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    """Traits of assemblies (TSV): one row for each alias of an assembly's name; the first row of an alias stays."""
    rows = spark.read.csv(path, sep="\t", header=True)
    name = F.coalesce(*(F.col(c) for c in ("query_asm", "asm") if c in rows.columns))
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    long = rows.withColumn("_at", at).filter(name.isNotNull() & (name != "")).select(F.explode(name_aliases(name)).alias("alias"), "_at", *rows.columns)
    return top_per_key(long.filter("alias != ''"), ["alias"], [F.col("_at")]).drop("_at")


def trait_table(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long rows (species, genus, trait_name, value) as one row a species, and one a genus; of repeated traits the largest value stays.

    A missing genus is the species' first word. Traits that are not known are left out.
    """
    species = F.lower(F.trim(F.replace(F.coalesce("species", F.lit("")), F.lit("_"), F.lit(" "))))
    genus = F.lower(F.trim(F.coalesce("genus", F.lit(""))))
    named = rows.select(species.alias("species"), F.when(genus != "", genus).otherwise(F.substring_index(species, " ", 1)).alias("genus"), F.lower(F.trim("trait_name")).alias("trait"), F.trim("value").alias("value")).filter("trait != '' AND value != ''")
    columns: dict[str, Column] = {}
    for trait, names in TRAITS.items():
        for name in names:
            columns[name] = F.max(F.when(F.col("trait") == trait, F.col("value"))).alias(name)
    one = lambda key: named.filter(F.col("trait").isin(*TRAITS) & (F.col(key) != "")).groupBy(key).agg(*columns.values())
    return one("species"), one("genus")


def said(*values: Column) -> Column:
    """The first value that says something, else '.'."""
    return F.coalesce(*(F.when(~v.isin("", "."), v) for v in values), F.lit("."))


def inferred_trait(m: dict[str, Column]) -> Column:
    """A way of life from taxonomy: keys species, genus, family, order, class, phylum, scenario."""
    low = {k: F.lower(F.coalesce(v, F.lit(""))) for k, v in m.items()}
    names = lambda text, words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    amf = F.contains(low["scenario"], F.lit("arbuscular")) | low["genus"].isin(*AMF_GENERA) | reduce(lambda a, b: a | b, [low[k].isin(*AMF_HIGHER) for k in ("phylum", "class", "order", "family")])
    return (
        F.when(amf, "Symbiotroph_arbuscular_mycorrhizal")
        .when(names(low["species"], PLANT_PATHOGENS) | low["genus"].isin(*PLANT_PATHOGENS), "Pathotroph_plant_pathogen")
        .when(low["genus"].isin(*OPPORTUNISTS) | F.contains(low["species"], F.lit("candida")), "Yeast_opportunistic_pathogen")
        .when(low["genus"].isin(*YEASTS), "Saprotroph_yeast")
        .when(low["order"].isin(*WOOD_DECAY), "Saprotroph_wood_decay")
        .when(F.contains(low["scenario"], F.lit("pathogen")), "Pathotroph")
        .otherwise(".")
    )


CONTEXT = ("species", "primary_lifestyle", "secondary_lifestyle", "trophic_mode", "substrate_or_host")


def ecological_context(meta: DataFrame, traits: DataFrame, by_species: DataFrame, by_genus: DataFrame) -> DataFrame:
    """species, ecological_trait, secondary_lifestyle, trophic_mode and substrate_or_host of each assembly.

    meta: query_asm, species, genus, family, order, class, phylum, scenario, lifestyle. Its own traits (by alias) come first, then those of its species, else of its
    genus, then its metadata, then what its taxonomy says.
    """
    own = traits.select("alias", *[(F.col(c) if c in traits.columns else F.lit(None).cast("string")).alias(f"own_{c}") for c in CONTEXT])
    rows = alias_join(meta, own, name_aliases(F.col("query_asm")), "alias", ["query_asm"])
    rows = rows.withColumn("_species", said(F.col("own_species"), F.col("species")))
    key = F.lower(F.trim(F.replace("_species", F.lit("_"), F.lit(" "))))
    rows = rows.withColumn("_s", key).withColumn("_g", F.substring_index(key, " ", 1))
    names = CONTEXT[1:]
    side = lambda table, name, to: table.select(F.col(name).alias(to), F.struct(*[(F.col(c) if c in table.columns else F.lit(None).cast("string")).alias(c) for c in names]).alias(f"{to}_row"))
    rows = rows.join(side(by_species, "species", "_s"), "_s", "left").join(side(by_genus, "genus", "_g"), "_g", "left")
    found = F.coalesce("_s_row", "_g_row")
    nothing = lambda c: F.coalesce(c, F.lit(""))
    primary = said(*map(nothing, (F.col("own_primary_lifestyle"), F.col("own_trophic_mode"), found["primary_lifestyle"], found["trophic_mode"], F.col("lifestyle"), inferred_trait({k: F.col(k) for k in ("species", "genus", "family", "order", "class", "phylum", "scenario")}))))
    rows = rows.withColumn("_primary", primary)
    return rows.select(
        "query_asm", F.col("_species").alias("species"), F.col("_primary").alias("ecological_trait"), said(nothing(F.col("own_secondary_lifestyle")), nothing(found["secondary_lifestyle"])).alias("secondary_lifestyle"),
        said(nothing(F.col("own_trophic_mode")), nothing(found["trophic_mode"]), F.col("_primary")).alias("trophic_mode"), said(nothing(F.col("own_substrate_or_host")), nothing(found["substrate_or_host"])).alias("substrate_or_host"),
    )


def findings(candidates: DataFrame, support: DataFrame, single: DataFrame, tiers: DataFrame) -> DataFrame:
    """Candidates with how many comparators support them, whether a single reference has them too, whether they are unique, and their tier.

    candidates and ``single`` are calls; ``support`` (locus, source) and ``tiers`` (locus, tier) are keyed as by ``locus_key``. A call of a single reference counts at
    the same locus; a unique one has neither support nor such a call.
    """
    rows = candidates.withColumn("locus", locus_key())
    n = support.groupBy("locus").agg(F.count_distinct("source").alias("comparator_support_count"))
    alone = single.select(locus_key().alias("locus")).distinct().withColumn("_single", F.lit(True))
    best = tiers.groupBy("locus").agg(F.min("tier").alias("evidence_tier"))
    found = rows.join(n, "locus", "left").join(alone, "locus", "left").join(best, "locus", "left").na.fill(0, ["comparator_support_count"])
    yes = lambda c: F.when(c, "yes").otherwise("no")
    equivalent = F.coalesce("_single", F.lit(False))
    return found.select(*candidates.columns, "comparator_support_count", yes(equivalent).alias("single_reference_equivalent"), yes(~equivalent & (F.col("comparator_support_count") == 0)).alias("unique"), F.coalesce("evidence_tier", F.lit(".")).alias("evidence_tier"))


def comparators(calls: DataFrame, callers: dict[str, list[str]], contigs: DataFrame) -> DataFrame:
    """For each mode and each caller that it should have: whether it gave output, how many calls, how many off-reference ones and how many on contigs outside ``contigs``."""
    spark = calls.sparkSession
    wanted = spark.createDataFrame([(m, c) for m, names in callers.items() for c in names], "query_mode string, method string")
    known = contigs.select(F.col("contig").alias("_known")).distinct()
    marked = calls.join(known, F.col("contig") == F.col("_known"), "left")
    counts = marked.groupBy("query_mode", "method").agg(F.count("*").alias("calls"), F.count_if(F.col("svtype") == "OFF_REF").alias("off_ref"), F.count_if(F.col("_known").isNull()).alias("misrouted"))
    return wanted.join(counts, ["query_mode", "method"], "left").na.fill(0).withColumn("present", F.col("calls") > 0)


def combined(*tables: DataFrame) -> DataFrame:
    """The rows of several tables by column name, exact duplicates once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).dropDuplicates()


def with_biology(novel: DataFrame, biology: DataFrame) -> DataFrame:
    """Novel calls with their biology, by the assembly's plain name and the call's place and type."""
    from strandlake.functions.scores import sample_stem

    keys = ["contig", "pos", "end", "svtype"]
    named = lambda rows: rows.withColumn("_asm", F.lower(sample_stem(F.col("query_asm"))))
    more = [c for c in biology.columns if c not in (*novel.columns, "query_asm")]
    return named(novel).join(named(biology).select("_asm", *keys, *more), ["_asm", *keys], "left").select(*novel.columns, *more)


def truth_of_others(truth: DataFrame, representatives: DataFrame, most: int = 1000) -> DataFrame:
    """Each true call once for every representative of another species (at most ``most`` of them, else an error)."""
    reps = [(r["reference"], r["species"]) for r in representatives.select("reference", "species").distinct().limit(most + 1).collect()]
    if len(reps) > most:
        raise ValueError(f"more than {most} representatives")
    each = F.array(*[F.struct(F.lit(r).alias("reference"), F.lit(s).alias("_species")) for r, s in sorted(reps)]) if reps else F.array().cast("array<struct<reference:string,_species:string>>")
    return truth.withColumn("_r", F.explode(each)).filter(~F.col("_r._species").eqNullSafe(F.col("species"))).select(*truth.columns, "_r.reference")


def harmonised(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names: the first alternative that the table has, else null; size and F1 are derived where they are missing."""
    have = {k: next((c for c in [k, *v] if c in rows.columns), None) for k, v in names.items()}
    out = rows.select(*[(F.col(c) if c else F.lit(None).cast("string")).alias(k) for k, c in have.items()], *[c for c in rows.columns if c not in have and c not in have.values()])
    if have.get("svlen", "") is None and {"pos", "end"} <= set(out.columns):
        out = out.withColumn("svlen", F.abs(F.col("end") - F.col("pos")))
    if have.get("f1", "") is None and {"precision", "recall"} <= set(out.columns):
        out = out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return out


def downsampled(reads: DataFrame, key: str, name: str, length: str, coverage: Column, target: float, modulus: int = 1_000_003) -> DataFrame:
    """A stable share of each key's reads that brings its coverage to the target, where it is over 1.2 times that; the longest read always stays (a sampling operator)."""
    own = reads.groupBy(key).agg(F.sum(length).alias("_bases"), F.max_by(name, F.struct(length, name)).alias("_longest"))
    joined = reads.join(own.withColumn("_coverage", coverage), key)
    share = F.when(F.col("_coverage") > 1.2 * target, target / F.col("_coverage")).otherwise(1.0)
    place = F.conv(F.substring(F.md5(F.col(name).cast("string")), 1, 8), 16, 10).cast("long") % modulus
    return joined.filter((place <= F.floor(share * modulus)) | (F.col(name) == F.col("_longest"))).select(*reads.columns)


def order_statistics(rows: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """Each row's predecessor and successor, the running sum of its weights up to it, and the sum of the range to the next row."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.select("*", F.lag(order).over(w).alias("predecessor"), F.lead(order).over(w).alias("successor"), F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("prefix_sum"))


def kth(rows: DataFrame, keys: list[str], order: str, weight: str, k: int) -> DataFrame:
    """The first row of each key at which the running sum of weights reaches k."""
    return order_statistics(rows, keys, order, weight).filter(F.col("prefix_sum") >= k).groupBy(*keys).agg(F.min(order).alias(order))
