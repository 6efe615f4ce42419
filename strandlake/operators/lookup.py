"""Lookups under several names, and classifications by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_aliases(name: Column) -> Column:
    """The names under which a sample may be known, best first: as it is, without extension, without numeric suffix, its accession, its base name."""
    stem = F.regexp_replace(name, r"\.(fa|fasta|fna)(\.gz)?$", "")
    accession = F.regexp_replace(F.regexp_extract(name, r"(GC[AF]_\d+\.\d+)", 1), r"\.", "_")
    return F.array_distinct(F.array(name, stem, F.regexp_replace(stem, r"[._]\d+$", ""), accession, F.regexp_replace(stem, r"^.*/", "")))


def alias_join(left: DataFrame, right: DataFrame, aliases: Column, key: str, row_id: list[str]) -> DataFrame:
    """Joins each left row with the right row of its first alias that has one; ``row_id`` tells left rows apart."""
    record = right.select(F.col(key).alias("_key"), F.struct(*right.columns).alias("_record"))
    long = left.select(*row_id, F.posexplode(aliases).alias("_rank", "_alias"))
    hit = long.join(record, F.col("_alias") == F.col("_key")).groupBy(*row_id).agg(F.min_by("_record", "_rank").alias("_hit"), F.min("_rank").alias("alias_rank"))
    return left.join(hit, row_id, "left").select(*left.columns, "alias_rank", *[F.col(f"_hit.{c}").alias(c) for c in right.columns if c not in left.columns])


def wildcard_join(left: DataFrame, right: DataFrame, asm: str, contig: str, value: str, wildcard: str = ".") -> DataFrame:
    """The value of (asm, contig), else of ('.', contig)."""
    own = right.filter(F.col(asm) != wildcard).select(asm, contig, F.col(value).alias("_own"))
    any_ = right.filter(F.col(asm) == wildcard).select(contig, F.col(value).alias("_any"))
    return left.join(own, [asm, contig], "left").join(any_, contig, "left").withColumn(value, F.coalesce("_own", "_any")).drop("_own", "_any")


def prefix_owner(names: DataFrame, owners: DataFrame, name: str, owner: str, separator: str = "_") -> DataFrame:
    """The owner of each name: equal, or a prefix up to a separator; the longest wins.

    A name's prefixes are exploded and looked up, instead of comparing all names with all owners.
    """
    parts = F.split(F.col(name), separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    long = names.select(name, F.posexplode(prefixes).alias("_n", owner))
    return long.join(owners.select(owner).distinct(), owner).groupBy(name).agg(F.max_by(owner, "_n").alias(owner))


def first_present(frame: DataFrame, *names: str) -> Column:
    """The first of several alternative columns that the table has, else null."""
    have = [F.col(n) for n in names if n in frame.columns]
    return F.coalesce(*have) if have else F.lit(None)


def info_map(info: Column) -> Column:
    """KEY=VALUE;FLAG as a map; flags get '1'."""
    pairs = F.filter(F.split(info, ";"), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"^[^=]*=", "")).otherwise("1"))))


def candidate_class(hgt: Column, switch: Column, expression: Column, te: Column, novel: Column, svtype: Column) -> tuple[Column, Column]:
    """The class and priority of a candidate: the first rule that holds."""
    moving = svtype.isin("INS", "DUP", "INV", "TRA", "DEL")
    rules = [
        (hgt & switch, "hgt_clade_switch", 7), (hgt, "hgt_candidate", 6), (expression & te & switch, "te_expression_switch", 6), (expression & te, "te_expression_link", 6), (te & novel, "novel_te_architecture", 5),
        (switch & te, "te_clade_switch", 4), (switch, "clade_switch", 3), (te & moving, "te_structural", 3), (novel, "novel_sequence", 2), (moving, "structural", 1),
    ]
    name, rank = F.lit("other"), F.lit(0)
    for rule, label, priority in reversed(rules):
        name, rank = F.when(rule, label).otherwise(name), F.when(rule, priority).otherwise(rank)
    return name, rank


def guild(genus: Column, lifestyle: Column, genus_guilds: dict[str, str]) -> Column:
    """A guild by genus, else by words of the lifestyle, else unknown."""
    out = F.when(F.lower(lifestyle).rlike("mycorrhiz|symbio"), "mutualist").when(F.lower(lifestyle).rlike("pathogen|parasit"), "pathogen").when(F.lower(lifestyle).rlike("saprot|decay|rot"), "saprotroph").otherwise("unknown")
    for name, value in genus_guilds.items():
        out = F.when(genus == name, value).otherwise(out)
    return out


def best_rule(rows: DataFrame, rules: DataFrame, row_id: list[str], matches: Column, score: Column) -> DataFrame:
    """The best-scoring of a small broadcast table of rules for each row; the first rule on a tie."""
    scored = rows.join(F.broadcast(rules), matches, "left")
    order = F.struct(F.coalesce(score, F.lit(0)).alias("s"), (-F.coalesce(F.col("rule"), F.lit(0))).alias("r"))
    return scored.groupBy(*row_id).agg(F.max_by("rule", order).alias("rule"), F.max(F.coalesce(score, F.lit(0))).alias("rule_score"))
