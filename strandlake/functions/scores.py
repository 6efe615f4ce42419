"""Column functions of calls: tiers, evidence, genotypes, statistics, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
#: Labels that stand for nothing.
NULL_LABELS = ("", ".", "NA", "N/A", "NAN", "NONE", "NULL", "UNKNOWN", "UNCLASSIFIED")
#: Position and length tolerances of matching by type, and their defaults.
POSITION_TOLERANCE = {"INS": 500, "DEL": 2500, "DUP": 2500, "INV": 10_000, "TRA": 10_000, "OFF_REF": 500}
LENGTH_TOLERANCE = {"INS": 0.30, "DEL": 0.10, "DUP": 0.10, "INV": 1.0, "TRA": 1.0, "OFF_REF": 1.0}


def choice(of: Column, table: dict, default) -> Column:
    """A lookup in a small table of fixed values."""
    out = F.lit(default)
    for key, value in reversed(table.items()):
        out = F.when(of == key, F.lit(value)).otherwise(out)
    return out


def position_tolerance(svtype: Column) -> Column:
    return choice(svtype, POSITION_TOLERANCE, 2500)


def length_tolerance(svtype: Column) -> Column:
    return choice(svtype, LENGTH_TOLERANCE, 0.10)


def type_group(svtype: Column) -> Column:
    """Types that may match each other."""
    return F.when(svtype.isin("DEL", "TDEL"), "DEL").when(svtype.isin("INS", "DUP", "TANDEM_DUP"), "INSDUP").when(svtype.startswith("TRA"), "TRA").otherwise(svtype)


def masked(label: Column) -> Column:
    """Null for labels that stand for nothing."""
    return F.when(~F.upper(F.trim(label)).isin(*NULL_LABELS), label)


def first_label(*labels: Column) -> Column:
    """The first label that says something."""
    return F.coalesce(*(masked(x) for x in labels))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson score interval of k of n; (0, 0) for n = 0."""
    p = k / n
    centre, denominator = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (centre - half) / denominator), F.least(F.lit(1.0), (centre + half) / denominator)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for b = 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), by the sign of x so that exp never overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def reliability(layer: Column, mapq: Column, breakpoint_support: Column, span_support: Column) -> Column:
    """How far a layer of evidence is trusted."""
    mq, sup = clamp(mapq / 60, 0.0, 1.0), 0.5 * clamp(breakpoint_support, 0.0, 1.0) + 0.5 * clamp(span_support, 0.0, 1.0)
    both = 0.6 * mq + 0.4 * sup
    return F.when(layer == "ASM", 0.70 + 0.30 * F.greatest(mq, sup)).when(layer == "LR", 0.55 + 0.45 * both).otherwise(0.45 + 0.55 * both)


def evidence_weight(layer: Column, depth: Column, alt: Column, ref: Column, mapq: Column, bp: Column, span: Column) -> Column:
    """A layer's term of the posterior log-odds; sum it over layers and add the prior's logit."""
    return reliability(layer, mapq, bp, span) * F.log1p(depth) * (alt - ref)


def logit(p: Column) -> Column:
    q = clamp(p, 1e-6, 1 - 1e-6)
    return F.log(q / (1 - q))


def novelty_tier(overlap: Column) -> Column:
    """The tier of a sequence by its best overlap with any reference."""
    return F.when(overlap <= 0, "NOVEL").when(overlap < 0.05, "NOVEL_WEAK").when(overlap < 0.20, "DIVERGED").otherwise("OFF_REF_KNOWN")


def cross_clade_tier(same: Column, other: Column) -> Column:
    """HGT candidates are close to another clade and far from their own; else the plain tier."""
    hgt = (same < 0.10) & (other >= 0.08) & (other - same >= 0.05)
    return F.when(hgt, "HGT_CROSS_CLADE").otherwise(novelty_tier(F.greatest(same, other)))


def cosine_genotype(support_alt: Column, support_ref: Column, k: Column) -> tuple[Column, Column]:
    """Genotype and quality by the best cosine with the templates of 0/0, 0/1 and 1/1."""
    norm = F.sqrt(support_alt * support_alt + support_ref * support_ref + k * k)

    def cosine(a: float, r: float) -> Column:
        return ratio(a * support_alt + r * support_ref + k * k, norm * F.sqrt(F.lit(a * a + r * r) + k * k))

    ref, het, alt = cosine(0.0, 1.0), cosine(1.0, 1.0), cosine(1.0, 0.0)
    best = F.greatest(ref, het, alt)
    second = ref + het + alt - best - F.least(ref, het, alt)
    genotype = F.when(het >= best, "0/1").when(alt >= best, "1/1").otherwise("0/0")
    return genotype, clamp(F.lit(1.0) + 100 * (best - second), 1.0, 60.0)


def normalized_svlen(svtype: Column, length: Column, assembly: Column) -> Column:
    """Deletions are negative, translocations have no length, other lengths are positive (at least 1 in read modes)."""
    size = F.abs(length)
    return F.when(svtype.startswith("TRA"), F.lit(0)).when(svtype == "DEL", -size).otherwise(F.when(assembly, size).otherwise(F.greatest(size, F.lit(1))))


def normalized_end(svtype: Column, pos: Column, length: Column) -> Column:
    """Insertions and translocations end where they begin."""
    return F.when(svtype.isin("INS", "OFF_REF") | svtype.startswith("TRA"), pos).otherwise(pos + F.greatest(F.abs(length) - 1, F.lit(0)))


def effective_support(reads: Column, anchors: Column, layers: Column, support: Column) -> Column:
    """Read modes: anchors, else layers, else 0. Assemblies: read support if known, else anchors, else layers."""
    return F.when(reads, F.when(anchors > 0, anchors).when(layers > 0, layers).otherwise(0)).otherwise(F.when(support >= 0, support).when(anchors > 0, anchors).otherwise(layers))


def coverage_tier(mode: Column, coverage: Column) -> Column:
    """LOW, NORMAL or HIGH by the mode's thresholds."""
    low, high = choice(mode, {"assembly": 5.0, "long": 8.0, "short": 12.0}, 5.0), choice(mode, {"assembly": 60.0, "long": 35.0, "short": 60.0}, 60.0)
    return F.when(coverage <= 0, "UNKNOWN").when(coverage < low, "LOW").when(coverage >= high, "HIGH").otherwise("NORMAL")


def detected_mode(fastq: Column, median: Column) -> Column:
    """The query mode by file kind and median length."""
    return F.when(fastq, F.when(median >= 300, "long").otherwise("short")).otherwise(F.when(median < 300, "short").when(median < 2000, "long").otherwise("assembly"))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The odds ratio with half a count added to each cell."""
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def interval_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The gap between two closed intervals, 0 if they overlap."""
    return F.greatest(F.lit(0), s2 - e1, s1 - e2)


def inversion_lengths_agree(a: Column, b: Column) -> Column:
    """Within a tenth of the shorter length, rounded; never if either is 0."""
    low, high = F.least(a, b), F.greatest(a, b)
    return (low > 0) & (high - low <= F.floor(0.10 * low + 0.5))


def topology(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How two alleles' intervals lie to each other."""
    nested = ((a0 <= b0) & (b1 <= a1)) | ((b0 <= a0) & (a1 <= b1))
    return F.when((a1 < b0) | (b1 < a0), "PROPERLY_TRIALLELIC").when(nested, "NESTED").otherwise("OVERLAPPING")


def element_group(element: Column) -> Column:
    """The report's group of an element class, whose name is read without blanks and in capitals; none, '.' and NONE are structural."""
    name = F.upper(F.trim(element))
    name = F.when(name.isin("", "."), "NONE").otherwise(F.coalesce(name, F.lit("NONE")))
    return (
        F.when(name.startswith("TE_") | name.isin("REPEAT", "LTR", "LINE", "SINE", "TIR"), "TE / repeat")
        .when(name == "HGT", "HGT / Starship")
        .when(name == "RIP", "RIP / genome defense")
        .when(name == "NONE", "Structural (other)")
        .otherwise(name)
    )


def sample_stem(name: Column) -> Column:
    """A file name without folders, compression and sequence suffixes."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?i)\.(fa|fasta|fna|fq|fastq|vcf|tsv)(\.gz)?$", "")


def alphanumeric(name: Column) -> Column:
    """Lower case letters and digits only."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def size_bin(length: Column) -> Column:
    """Right-closed bins of a length's size."""
    size, out = F.abs(length), F.lit(">100000")
    steps = [(50, "0-50"), (100, "51-100"), (500, "101-500"), (1000, "501-1000"), (10_000, "1001-10000"), (100_000, "10001-100000")]
    for high, name in reversed(steps):
        out = F.when(size <= high, name).otherwise(out)
    return out
