"""Manifests, VCF, interval files, TSV and GFA: readers to typed columns, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import scores as S
from strandlake.functions.evidence import breakpoints
from strandlake.operators.lookup import first_present, info_map
from strandlake.operators.selection import top_per_key
from strandlake.sources import files

#: The columns of the file formats.
MANIFEST = ("asm", "phylum", "class", "order", "family", "genus", "clade_name", "clade_rank", "fasta_path")
CLADES = ("clade_name", "clade_rank", "phylum", "graph_path", "genome_count", "sv_bubbles", "compressed_bytes", "fasta_paths", "crc32", "centroid_hashes")
ROUTING = ("clade_name", "clade_rank", "phylum", "cidx_path", "graph_path", "gbwt_path", "min_path", "genome_count", "nodes", "paths", "centroid_hashes")
HITS = (
    "query_asm", "query_contig", "type", "ref_asm", "ref_contig", "ref_pos", "ref_end", "pos", "end", "svlen", "block_score", "anchors", "genotype", "gq", "annotation",
    "alignment_mode", "query_mode", "fused_posterior_alt", "fused_logodds_alt", "fused_effective_depth", "fused_layers", "read_support",
)


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f"))


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The nine-column manifest, or its short forms of four or five columns (missing ones null)."""
    rows = _fields(spark.read.text(path).filter("NOT startswith(value, '#') AND trim(value) != ''"))
    long = F.size("f") >= 9
    short = {"asm": 0, "phylum": 1, "clade_name": 2, "clade_rank": 3, "fasta_path": 4}
    return rows.select(*[F.when(long, _field(i)).otherwise(_field(short[c]) if c in short else F.lit(None)).alias(c) for i, c in enumerate(MANIFEST)])


def read_header_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with a header, all columns strings; damaged rows are dropped."""
    return spark.read.option("mode", "DROPMALFORMED").csv(path, sep="\t", header=True)


def _hash_list(column: str) -> Column:
    return F.filter(F.transform(F.split(column, ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def read_clades(spark: SparkSession, path: str) -> DataFrame:
    """The clade manifest: lists become arrays, numbers are cast."""
    rows = read_header_tsv(spark, path).toDF(*CLADES)
    return rows.select("clade_name", "clade_rank", "phylum", "graph_path", *[F.col(c).try_cast("long").alias(c) for c in CLADES[4:7]], F.split("fasta_paths", ",").alias("fasta_paths"), "crc32", _hash_list("centroid_hashes").alias("centroid_hashes"))


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    """The routing manifest; hashes that are not numbers are skipped."""
    rows = read_header_tsv(spark, path).toDF(*ROUTING)
    return rows.select(*ROUTING[:7], *[F.col(c).try_cast("long").alias(c) for c in ROUTING[7:10]], _hash_list("centroid_hashes").alias("centroid_hashes"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF records with their INFO as a map (flags '1') and the common keys typed; a breakend's mate is read from INFO, else from its ALT."""
    rows = _fields(spark.read.text(path).filter("NOT startswith(value, '#')")).filter(F.size("f") >= 8)
    info = rows.select(_field(0).alias("contig"), _field(1).try_cast("long").alias("pos"), _field(2).alias("id"), _field(3).alias("ref"), _field(4).alias("alt"), _field(5).try_cast("double").alias("qual"), _field(6).alias("filter"), info_map(_field(7)).alias("info"), F.slice("f", 10, 1000).alias("samples"))
    key = lambda k: F.try_element_at("info", F.lit(k))
    mate = lambda g: F.nullif(F.regexp_extract("alt", r"[\[\]]([^\[\]]+):(\d+)[\[\]]", g), F.lit(""))
    breakend = F.col("alt").rlike(r"[\[\]]")
    kind = F.coalesce(F.when(key("SVTYPE") == "BND", "TRA").otherwise(key("SVTYPE")), F.when(breakend, "TRA"), F.regexp_extract("alt", "<([A-Z_]+)", 1))
    return info.select("*", kind.alias("svtype"), key("SVLEN").try_cast("long").alias("svlen"), F.coalesce(key("END").try_cast("long"), F.col("pos")).alias("end"), key("QASM").alias("query_asm"), F.coalesce(key("CHR2"), mate(1)).alias("mate_contig"), F.coalesce(key("POS2").try_cast("long"), mate(2).try_cast("long")).alias("mate_pos"))


#: The INFO keys that are written, their number, type and meaning.
INFO = {
    "SVTYPE": ("1", "String", "SV type"), "SVLEN": ("1", "Integer", "SV length"), "END": ("1", "Integer", "End pos"), "ANNOT": ("1", "String", "Annotation"),
    "REFCONTIG": ("1", "String", "Reference contig of an anchored event"), "REFPOS": ("1", "Integer", "Reference start of an anchored event"), "REFEND": ("1", "Integer", "Reference end of an anchored event"),
    "CLADE": ("1", "String", "Routed clade"), "CLADE_RANK": ("1", "String", "Rank of the routed clade"), "PHYLUM": ("1", "String", "Phylum"), "BSCORE": ("1", "Float", "Block score"), "MAPQ": ("1", "Float", "Mapping quality"),
    "OFFREF": ("0", "Flag", "Off-reference sequence"), "NR": ("0", "Flag", "Non-reference allele"), "TOPO": ("1", "String", "Topology of alleles"), "OFF_REF_TIER": ("1", "String", "Novelty tier"),
    "CHR2": ("1", "String", "Mate contig of a translocation"), "POS2": ("1", "Integer", "Mate position of a translocation"), "END2": ("1", "Integer", "Mate end of a translocation"),
    "EC": ("1", "String", "Element class"), "QASM": ("1", "String", "Query assembly"), "QMODE": ("1", "String", "Query mode"),
}
#: The column behind each INFO key that is copied.
COPIED = {
    "ANNOT": "annotation", "REFCONTIG": "ref_contig", "REFPOS": "ref_pos", "REFEND": "ref_end", "CLADE": "clade", "CLADE_RANK": "clade_rank", "PHYLUM": "phylum", "BSCORE": "block_score", "MAPQ": "mapq",
    "TOPO": "topology", "OFF_REF_TIER": "off_ref_tier", "CHR2": "mate_contig", "POS2": "mate_pos", "END2": "mate_end", "EC": "element_class", "QASM": "query_asm", "QMODE": "query_mode",
}


def vcf_header(samples: list[str]) -> list[str]:
    """The header lines: every INFO key that ``vcf_lines`` may write is declared."""
    described = [f'##INFO=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in INFO.items()]
    kinds = [f'##ALT=<ID={k},Description="{d}">' for k, d in (("INS", "Insertion"), ("DEL", "Deletion"), ("DUP", "Duplication"), ("INV", "Inversion"), ("TRA", "Translocation"), ("OFF_REF", "Off-reference sequence"))]
    formats = ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">', '##FILTER=<ID=LowGQ,Description="Genotype quality below 10">']
    return ["##fileformat=VCFv4.3", "##source=strandlake", *described, *kinds, *formats, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def _header_rows(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(0, i, "", 0, h) for i, h in enumerate(lines)], "rank int, n int, contig string, pos long, value string")


def _site(calls: DataFrame) -> tuple[Column, Column]:
    """INFO and ALT of calls; a translocation with a mate is a breakend."""
    have = lambda c: F.col(c) if c in calls.columns else F.lit(None).cast("string")
    assembly = F.coalesce(F.col("query_mode") == "assembly", F.lit(True))
    size, end = S.normalized_svlen(F.col("type"), F.col("svlen"), assembly), S.normalized_end(F.col("type"), F.col("pos"), F.col("svlen"))
    copied = [F.concat(F.lit(f"{k}="), F.nullif(have(c).cast("string"), F.lit("."))) for k, c in COPIED.items() if c in calls.columns]
    novel = F.when(F.col("type") == "OFF_REF", "OFFREF;NR")
    info = F.concat_ws(";", F.format_string("SVTYPE=%s", "type"), F.format_string("SVLEN=%d", size.cast("long")), F.format_string("END=%d", end.cast("long")), *copied, novel)
    mate = F.col("type").startswith("TRA") & F.coalesce(have("mate_contig") != ".", F.lit(False))
    return info, F.when(mate, F.concat(F.lit("N["), have("mate_contig"), F.lit(":"), F.coalesce(have("mate_pos").cast("string"), F.lit("1")), F.lit("["))).otherwise(F.concat(F.lit("<"), "type", F.lit(">")))


def vcf_lines(calls: DataFrame) -> DataFrame:
    """(rank, value) lines of a VCF 4.3 file from hits columns; the header has rank 0."""
    info, alt = _site(calls)
    quality = F.round("gq").cast("int").cast("string")
    passed = F.when(F.col("gq") >= 10, "PASS").otherwise("LowGQ")
    line = F.concat_ws("\t", "query_contig", F.col("pos").cast("string"), F.concat_ws("_", "type", "query_contig", "pos"), F.lit("N"), alt, quality, passed, info, F.lit("GT:GQ"), F.concat_ws(":", "genotype", quality))
    body = calls.select(F.lit(1).alias("rank"), F.lit(0).alias("n"), F.col("query_contig").alias("contig"), F.col("pos").cast("long").alias("pos"), line.alias("value"))
    return _header_rows(calls.sparkSession, vcf_header(["SAMPLE"])).union(body)


def write_vcf(calls: DataFrame, path: str) -> None:
    """A folder of sorted part files, the first beginning with the header."""
    vcf_lines(calls).orderBy("rank", "n", "contig", "pos", "value").select("value").write.mode("overwrite").text(path)


def write_vcf_file(calls: DataFrame, path: str, compression: str = "none") -> None:
    """One VCF file, sorted, behind one header; with ``compression`` bgzf as block gzip."""
    body = vcf_lines(calls).filter("rank > 0").orderBy("contig", "pos", "value").select("value")
    files.write_file(body, path, "\n".join(vcf_header(["SAMPLE"])), compression)


def multisample_lines(calls: DataFrame, samples: list[str]) -> DataFrame:
    """VCF lines with a genotype column for each sample: one line a site (contig, pos, end, type), '0/0' where a sample lacks it.

    A call belongs to the sample of its name, else to the longest sample that its name begins with (letters and digits compared).
    """
    plain = S.alphanumeric(F.col("query_asm"))
    owner = F.lit(None).cast("string")
    for s in sorted(samples, key=lambda s: (len(s), s)):  # the longest one asked first
        key = "".join(c for c in s.lower() if c.isascii() and c.isalnum())
        owner = F.when(F.startswith(plain, F.lit(key)), s).otherwise(owner)
    exact = F.when(F.col("query_asm").isin(*samples), F.col("query_asm"))
    site = ["query_contig", "pos", "end", "type"]
    wide = calls.withColumn("_owner", F.coalesce(exact, owner)).filter("_owner IS NOT NULL").groupBy(*site).pivot("_owner", samples).agg(F.max("genotype"))
    rest = calls.groupBy(*site).agg(F.max("svlen").alias("svlen"), F.max("gq").alias("gq"), F.max("query_mode").alias("query_mode"))
    rows = wide.join(rest, site)
    info, alt = _site(rows)
    line = F.concat_ws("\t", "query_contig", F.col("pos").cast("string"), F.concat_ws("_", "type", "query_contig", "pos"), F.lit("N"), alt, F.round("gq").cast("int").cast("string"), F.lit("PASS"), info, F.lit("GT"), *[F.coalesce(F.col(f"`{s}`"), F.lit("0/0")) for s in samples])
    body = rows.select(F.lit(1).alias("rank"), F.lit(0).alias("n"), F.col("query_contig").alias("contig"), F.col("pos").cast("long").alias("pos"), line.alias("value"))
    return _header_rows(calls.sparkSession, vcf_header(samples)).union(body)


#: The columns of the table of ancestral sequences.
ANCESTRAL = ("query_asm", "query_contig", "clade", "clade_rank", "phylum", "variant_type", "breakpoints", "segment_bp", "aligned_bp", "mean_posterior", "ancestral_seq", "source_clade", "source_phylum")


def ancestral_table(calls: DataFrame, recombined: bool = True) -> DataFrame:
    """The thirteen columns of each call's ancestral sequence; what is not known is '.'.

    calls: hits columns with ref_asm, clade_rank, phylum, and ancestral, aligned, mean_posterior where there is a reconstruction.
    """
    have = lambda c: F.col(c) if c in calls.columns else F.lit(None).cast("string")
    text = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("."))
    places = breakpoints({"svtype": F.col("type"), "ref_contig": have("ref_contig"), "pos": F.col("pos"), "end": F.col("end"), "mate_contig": have("mate_contig"), "mate_pos": have("mate_pos").try_cast("long"), "mate_end": have("mate_end").try_cast("long")}, recombined)
    seq = F.nullif(have("ancestral"), F.lit(""))
    size = F.when(seq.isNotNull(), F.length(seq)).otherwise(F.greatest(F.lit(1), F.abs("svlen")))
    values = [F.col("query_asm"), F.col("query_contig"), have("ref_asm"), have("clade_rank"), have("phylum"), F.col("type"), places, size, F.coalesce(have("aligned").try_cast("long"), F.lit(0)), F.coalesce(have("mean_posterior").try_cast("double"), F.lit(0.0)), seq, F.coalesce(have("source_clade"), have("ref_asm")), F.coalesce(have("source_phylum"), have("phylum"))]
    return calls.select(*[(v if n in ("segment_bp", "aligned_bp", "mean_posterior") else text(v)).alias(n) for n, v in zip(ANCESTRAL, values, strict=True)])


def read_ancestral(spark: SparkSession, path: str) -> DataFrame:
    """The table of ancestral sequences folded to a row for each (query_asm, query_contig): sets of clades, phyla and types, whether any is recombined, the best posterior."""
    rows = read_header_tsv(spark, path)
    known = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != ".", F.col(c))))
    return rows.groupBy("query_asm", "query_contig").agg(known("clade").alias("clades"), known("phylum").alias("phyla"), known("variant_type").alias("types"), F.bool_or(F.contains("breakpoints", F.lit("->"))).alias("recombined"), F.max(F.col("mean_posterior").try_cast("double")).alias("mean_posterior"), F.max(F.col("segment_bp").try_cast("long")).alias("segment_bp"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def write_scores(scores: DataFrame, matches: DataFrame, truth: DataFrame, calls: DataFrame, folder: str) -> None:
    """The artifacts of a scoring run: the scores as TSV and JSON, the matches, and what was missed and false on either side."""
    write_tsv(scores, f"{folder}/scores.tsv")
    scores.write.mode("overwrite").json(f"{folder}/scores.json")
    write_tsv(matches, f"{folder}/matches.tsv")
    write_tsv(truth.join(matches.select(F.col("truth_id").alias("id")), "id", "left_anti"), f"{folder}/missed.tsv")
    write_tsv(calls.join(matches.select(F.col("call_id").alias("id")), "id", "left_anti"), f"{folder}/false.tsv")


def write_store(rows: DataFrame, path: str, *partitions: str) -> None:
    """Graphs, sketches and indexes are stored as Parquet in partitions (such as rank and phylum)."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def read_store(spark: SparkSession, path: str, **only: str) -> DataFrame:
    """A store, or the partitions of it that are asked for."""
    rows = spark.read.option("partitionInferTypes", "false").parquet(path)
    for name, value in only.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def write_hits(calls: DataFrame, path: str) -> None:
    """The hits TSV; columns that are missing are written as '.'."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) if c in calls.columns else F.lit(".").alias(c) for c in HITS]
    calls.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """The hits TSV with numbers cast and sentinels null; the last row of a (contig, pos, end, type) stays."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    rows = read_header_tsv(spark, path).withColumn("_at", at)
    numbers = {"ref_pos", "ref_end", "pos", "end", "svlen", "anchors", "fused_layers", "read_support"}
    reals = {"block_score", "gq", "fused_posterior_alt", "fused_logodds_alt", "fused_effective_depth"}
    typed = rows.select(*[F.when(F.col(c) != ".", F.col(c)).try_cast("long" if c in numbers else "double" if c in reals else "string").alias(c) for c in HITS], "_at")
    return last_per_key(typed, ["query_contig", "pos", "end", "type"], "_at").drop("_at")


def gfa_lines(calls: DataFrame, reference: str = "ref_contig") -> DataFrame:
    """(value) GFA lines: header, reference anchors once, a segment and links for each call; off-reference ones unanchored."""
    spark = calls.sparkSession
    head = spark.createDataFrame([("H\tVN:Z:1.0",)], "value string")
    anchors = calls.filter("type != 'OFF_REF'").select(F.format_string("S\t%s\t*\tLN:i:%d", F.col(reference), F.lit(0)).alias("value")).distinct()
    name = F.concat_ws("_", "type", "query_contig", "pos")
    segments = calls.select(F.format_string("S\t%s\t*\tLN:i:%d\tSV:Z:%s", name, F.abs("svlen").cast("long"), "type").alias("value"))
    links = calls.filter("type != 'OFF_REF'").select(F.explode(F.array(F.format_string("L\t%s\t+\t%s\t+\t0M", F.col(reference), name), F.format_string("L\t%s\t+\t%s\t%s\t0M", name, F.col(reference), F.when(F.col("type") == "INV", "-").otherwise("+")))).alias("value"))
    paths = calls.select(F.format_string("P\t%s\t%s+\t*", F.concat("query_contig", F.lit("_"), name), name).alias("value"))
    return head.union(anchors).union(segments).union(links).union(paths)


def read_intervals(spark: SparkSession, path: str, kind: str, least_length: int = 0) -> DataFrame:
    """(contig, start, end) of GFF3, BED or BLAST-6 files, in order whatever the strand."""
    at = {"gff3": (0, 3, 4, 0), "bed": (0, 1, 2, 1), "blast6": (0, 6, 7, 0)}[kind]
    rows = _fields(spark.read.text(path).filter("NOT startswith(value, '#') AND trim(value) != ''"))
    a, b = _field(at[1]).try_cast("long") + at[3], _field(at[2]).try_cast("long")
    out = rows.select(_field(at[0]).alias("contig"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))
    return out.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") - F.col("start") + 1 >= least_length))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene annotations under several header spellings, start before end; assembly '.' is a wildcard."""
    rows = read_header_tsv(spark, path)
    a, b = first_present(rows, "start", "gene_start").try_cast("long"), first_present(rows, "end", "gene_end").try_cast("long")
    out = rows.select(F.coalesce(first_present(rows, "query_asm", "asm"), F.lit(".")).alias("asm"), first_present(rows, "query_contig", "contig", "seqid").alias("contig"), first_present(rows, "gene_id", "id").alias("gene_id"), first_present(rows, "gene_name", "name", "gene_id").alias("gene_name"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))
    return out.filter("contig IS NOT NULL AND start IS NOT NULL")


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """Sample-level expression: the first of several value columns, not below 0."""
    rows = read_header_tsv(spark, path)
    value = first_present(rows, "expression", "tpm", "fpkm", "rpkm", "count", "value").try_cast("double")
    return rows.select("sample", first_present(rows, "query_asm", "asm").alias("asm"), "gene_id", F.greatest(F.lit(0.0), value).alias("expression"), "condition").filter("expression IS NOT NULL")


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON cache of side data."""
    return spark.read.option("multiLine", True).json(path)


def discovered_shards(spark: SparkSession, glob: str, failed_glob: str) -> DataFrame:
    """Rows of all shards' TSVs but those whose folder has a failure marker."""
    rows = spark.read.csv(glob, sep="\t", header=True).withColumn("shard", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    failed = spark.read.format("binaryFile").load(failed_glob).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("shard"))
    return rows.join(failed, "shard", "left_anti")


def validation_report(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether each clade of index and manifest agrees in genome count."""
    a = index.groupBy("clade_name").agg(F.sum("genome_count").alias("indexed"))
    b = manifest.groupBy("clade_name").agg(F.count("*").alias("listed"))
    both = a.join(b, "clade_name", "full")
    return both.withColumn("status", F.when(F.col("indexed").eqNullSafe(F.col("listed")), "ok").otherwise("check"))


def summary_json(counts: DataFrame, key: str, value: str) -> DataFrame:
    """A one-row JSON of a counter."""
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("json"))


def last_per_key(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key."""
    return top_per_key(rows, keys, [F.col(ordinal).desc()])
