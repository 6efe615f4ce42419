"""Queries that call, annotate and link sequences: chains, elements, components, sub-clades, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequence as Q
from strandlake.functions import stats
from strandlake.operators import calling, detectors, evaluation, graph, sketch
from strandlake.operators.selection import top_per_key
from strandlake.plans.calls import calls
from strandlake.plans.documents import _SEQ_CTE, sequences
from strandlake.plans.registry import Tables, query
from strandlake.session import scratch_path
from strandlake.sources import tables


@query()
def mem_chain_calls(t: Tables) -> DataFrame:
    """Events of five bases or more between every hundredth document and the up to 24 others of largest overlap (Jaccard or containment, at least 0.01): routed by k-mers, then chained (kernel tested on planted events)."""
    p = sketch.postings(sequences(t), "doc_id", "seq", 16, "0")
    near = sketch.best_pairs(p.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "h"), p.select(F.col("doc_id").alias("reference"), "h"), 24, "overlap", drop_self=True)
    near = near.filter("overlap >= 0.01")
    near = top_per_key(near, ["query"], [F.col("overlap").desc(), F.col("reference")], 24)
    s = sequences(t).select(F.col("doc_id").alias("query"), F.col("seq").alias("q_seq"))
    r = sequences(t).select(F.col("doc_id").alias("reference"), F.col("seq").alias("r_seq"))
    pairs = near.select("query", "reference").join(s, "query").join(r, "reference")
    return calling.call_rows(pairs, ["query", "reference"], "q_seq", "r_seq", calling.CallParams(min_sv=5))


@query()
def element_annotation(t: Tables) -> DataFrame:
    """Element class, boundary, captain, donor and age of each whole document against its clade's mean GC (kernels tested on planted elements)."""
    s = sequences(t)
    mean = s.groupBy("lang").agg(F.avg(Q.gc_content(F.col("seq"))).alias("clade_gc"))
    # as many rows as there are clades
    rows = s.join(F.broadcast(mean), "lang").withColumn("host", F.col("seq"))
    return detectors.annotated(rows, ["doc_id", "lang"], "seq", "host", "clade_gc")


_TYPES = ("INS", "DEL", "INV", "OFF_REF", "DUP")


@query(
    f"""WITH {_SEQ_CTE}, c AS (SELECT doc_id, ['INS', 'DEL', 'INV', 'OFF_REF', 'DUP'][doc_id % 5 + 1] AS svtype, seq, (length(seq) * CASE doc_id % 2 WHEN 0 THEN 2 ELSE 3 END) // 5 AS cut FROM s),
    h AS (SELECT doc_id, svtype, substr(seq, 1, cut) AS q, substr(seq, cut + 1) AS r FROM c),
    w AS (SELECT *, least(length(q), length(r)) AS m, length(q) - length(r) AS rest, len(list_filter(list_zip(string_split(substr(q, 1, m), ''), string_split(substr(r, 1, m), '')), lambda x: x[1] = x[2])) AS same FROM h),
    z AS (SELECT *, substr(CASE svtype WHEN 'DEL' THEN q ELSE r END, 1, m) || CASE WHEN rest < 0 THEN substr(r, m + 1) WHEN svtype <> 'INS' THEN substr(q, m + 1) ELSE '' END AS anc,
      same * 0.995::DOUBLE + (m - same) * 0.65::DOUBLE + CASE WHEN rest < 0 THEN -rest * 0.80::DOUBLE WHEN svtype <> 'INS' THEN rest * 0.55::DOUBLE ELSE 0 END AS total FROM w)
    SELECT doc_id, svtype, CASE svtype WHEN 'INV' THEN 2 ELSE 1 END AS breakpoints, m AS aligned, md5(anc) AS digest, CASE WHEN anc = '' THEN 0 ELSE round(total / length(anc), 9) END AS mean_posterior FROM z WHERE m > 0"""
)
def ancestral_reconstruct(t: Tables) -> DataFrame:
    """Ancestral bases of the two parts of each whole document's sequence, for calls of five types."""
    cut = F.floor(F.length("seq") * F.when(F.col("doc_id") % 2 == 0, 2).otherwise(3) / 5).cast("int")
    rows = sequences(t).select("doc_id", F.get(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % 5).cast("int")).alias("svtype"), F.substring(F.col("seq"), F.lit(1), cut).alias("one"), F.substring(F.col("seq"), cut + 1, F.length("seq")).alias("other"))
    found = calling.ancestral_rows(rows, "doc_id", "one", "other", "svtype").join(rows.select("doc_id", "svtype"), "doc_id").filter("aligned > 0")
    return found.select("doc_id", "svtype", "breakpoints", "aligned", F.md5("ancestral").alias("digest"), F.round("mean_posterior", 9).alias("mean_posterior"))


#: Lines as paths of words, and the documents as clades; in every fourth document lines take turns on two contigs.
_WALKS = """l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS path, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    w AS (SELECT doc_id, path, CASE WHEN doc_id % 4 = 0 THEN 'c' || (path % 2) ELSE 'c' END AS contig, list_filter(string_split(line, ' '), lambda x: x <> '') AS words FROM l),
    r0 AS (SELECT doc_id, path AS ref, words AS rw, length(array_to_string(words, '')) AS bp FROM w WHERE len(words) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(array_to_string(words, '')) DESC, path) = 1),
    s AS (SELECT w.doc_id, path, contig, words[i] AS seg, i - 1 AS n FROM w, unnest(range(1, len(words) + 1)) AS u(i)),
    ri AS (SELECT doc_id, list(i - 1 ORDER BY i) AS spots, rw[i] AS seg FROM r0, unnest(range(1, len(rw) + 1)) AS u(i) GROUP BY ALL),
    o AS (SELECT s.doc_id, path, n, spots, row_number() OVER (PARTITION BY s.doc_id, path ORDER BY n) AS k FROM s JOIN r0 USING (doc_id) JOIN ri ON ri.doc_id = s.doc_id AND ri.seg = s.seg WHERE path <> ref),
    g AS (SELECT doc_id, path, 0::BIGINT AS k, -1::BIGINT AS n, -1::BIGINT AS last FROM (SELECT DISTINCT doc_id, path FROM o)
      UNION ALL SELECT o.doc_id, o.path, o.k, o.n, list_sort(list_transform(o.spots, lambda x: {'d': abs(x - g.last - 1), 'x': x}))[1].x FROM g JOIN o ON o.doc_id = g.doc_id AND o.path = g.path AND o.k = g.k + 1),
    p AS (SELECT doc_id, path, k, n, last AS chosen, lag(n) OVER x AS before, lag(last) OVER x AS start FROM g WINDOW x AS (PARTITION BY doc_id, path ORDER BY k)),
    e AS (SELECT doc_id, path, before AS a, n AS b, start AS ref_start, CASE WHEN chosen <= start THEN start + 1 ELSE chosen END AS ref_end FROM p WHERE k > 0 AND (n > before + 1 OR chosen <> start + 1)
      UNION ALL SELECT w.doc_id, w.path, coalesce(f.n, -1), len(w.words), coalesce(f.chosen, -1), len(rw) FROM w JOIN r0 USING (doc_id) LEFT JOIN (SELECT doc_id, path, max(n) AS n, arg_max(chosen, k) AS chosen FROM p GROUP BY ALL) f USING (doc_id, path) WHERE w.path <> ref AND len(w.words) - 1 > coalesce(f.n, -1)),
    v AS (SELECT e.*, w.contig, array_to_string(words[a + 2 : b], '') AS alt, words[a + 2 : b] AS aw, array_to_string(rw[ref_start + 2 : ref_end], '') AS allele FROM e JOIN w USING (doc_id, path) JOIN r0 USING (doc_id)),
    z AS (SELECT * FROM v WHERE greatest(length(alt), length(allele)) >= 40),
    h AS (SELECT DISTINCT doc_id, seg, contig FROM s),
    q AS (SELECT doc_id, path, a, list_sort(list(DISTINCT h.contig)) AS partners FROM (SELECT doc_id, path, a, contig, unnest(aw) AS seg FROM z) x JOIN h USING (doc_id, seg) WHERE h.contig <> x.contig GROUP BY ALL),
    y AS (SELECT z.doc_id, ref_start, ref_end, alt, allele, list_sort(list(path)) AS paths, arg_min(coalesce(partners, []), {'p': path, 'a': a}) AS partners FROM z LEFT JOIN q USING (doc_id, path, a) GROUP BY z.doc_id, ref_start, ref_end, alt, allele)"""


@query(
    f"""WITH RECURSIVE {_WALKS} SELECT doc_id, ref_start, ref_end, md5(alt) AS allele, length(allele) AS ref_len, length(alt) AS alt_len, length(alt) - length(allele) AS svlen, array_to_string(paths, ',') AS paths, array_to_string(partners, ',') AS partners,
      CASE WHEN len(partners) > 0 THEN 'TRA' WHEN allele <> '' AND starts_with(alt, allele || allele) THEN 'DUP' WHEN length(alt) > length(allele) THEN 'INS' WHEN length(alt) < length(allele) THEN 'DEL' ELSE 'COMPLEX' END AS svtype FROM y"""
)
def bubbles_of_lines(t: Tables) -> DataFrame:
    """Variants of each document's lines against its longest one, words as segments: bubbles of any length, steps back, and words of other contigs; against a recursion along each line."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("path", "line")).withColumn("path", F.col("path") + 1)
    words = lines.select("doc_id", "path", F.filter(F.split("line", " "), lambda x: x != "").alias("segments"))
    walks = words.withColumn("contig", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("c"), F.col("path") % 2)).otherwise("c"))
    found = graph.bubbles_of_paths(walks, "doc_id", "path", "contig", "segments", with_allele=True)
    return found.select("doc_id", "ref_start", "ref_end", F.md5("alt").alias("allele"), "ref_len", "alt_len", "svlen", F.array_join("paths", ",").alias("paths"), F.array_join("partners", ",").alias("partners"), "svtype")


_K = 15


@query(
    f"""WITH RECURSIVE {_SEQ_CTE}, k AS (SELECT substr(seq, i, {_K}) AS k, count(*) AS c FROM (SELECT seq, unnest(range(1, length(seq) - {_K - 2})) AS i FROM s) GROUP BY ALL),
    p AS (SELECT substr(k, 1, {_K - 1}) AS m, count(*) AS n, min(k) AS b FROM k GROUP BY m), q AS (SELECT substr(k, 2) AS m, count(*) AS n, min(k) AS a FROM k GROUP BY m),
    l AS (SELECT a, b FROM p JOIN q USING (m) WHERE p.n = 1 AND q.n = 1 AND a <> b),
    r AS (SELECT k AS head, k AS node, 0 AS rank FROM k ANTI JOIN l ON l.b = k.k UNION ALL SELECT r.head, l.b, r.rank + 1 FROM r JOIN l ON l.a = r.node)
    SELECT head, count(*) AS kmers, md5(string_agg(CASE rank WHEN 0 THEN node ELSE right(node, 1) END, '' ORDER BY rank)) AS digest, sum(c)::BIGINT AS support FROM r JOIN k ON k.k = r.node GROUP BY head HAVING count(*) >= 30"""
)
def unitigs_of_documents(t: Tables) -> DataFrame:
    """Ways of thirty k-mers and more through the graph of all documents' k-mers that do not branch, against a recursion step by step."""
    parts = graph.unitigs_of_sequences(sequences(t), "seq", _K, 30)
    ways = parts.groupBy("head").agg(F.sum("kmers").alias("kmers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq"))), lambda x: x["seq"]), "").alias("seq"), F.sum("support").alias("support"))
    return ways.filter("kmers >= 30").select("head", "kmers", F.md5("seq").alias("digest"), "support")


@query(
    """WITH RECURSIVE l AS (SELECT DISTINCT doc_id, md5(line) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 60),
    f AS (SELECT h, min(doc_id) AS head FROM l GROUP BY h HAVING count(*) > 1), e AS (SELECT DISTINCT doc_id AS a, head AS b FROM l JOIN f USING (h) WHERE doc_id <> head),
    b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS root FROM b UNION SELECT b.b, r.root FROM r JOIN b ON r.node = b.a AND r.root < b.b)
    SELECT node, min(root) AS root FROM r GROUP BY node"""
)
def connected_components_docs(t: Tables) -> DataFrame:
    """Components of documents that share a long line; a line's documents are linked to its first, never all with all."""
    lines = t.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.length("line") >= 60).select("doc_id", F.md5("line").alias("h"))
    heads = lines.groupBy("h").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("h", "head")
    links = lines.join(heads, "h").filter("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    return graph.connected(links)


_SUB = """s AS (SELECT doc_id, lang, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
PIVOTS = ("ACGT", "GGCC", "TTAA", "CATG", "GATC", "AGCT", "TGCA", "CCGG", "AATT", "GTAC")


@query(
    f"""WITH {_SUB}, k AS (SELECT doc_id, lang, {' + '.join(f"CASE WHEN contains(seq, '{p * 2}') THEN {1 << i} ELSE 0 END" for i, p in enumerate(PIVOTS))} AS key FROM s)
    SELECT lang, key::BIGINT AS key, count(*) AS n FROM k GROUP BY ALL"""
)
def subclade_bitkeys(t: Tables) -> DataFrame:
    """Keys of pivots that each document has, counted by clade."""
    bits = sum((F.when(F.contains("seq", F.lit(p * 2)), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(PIVOTS)), F.lit(0))
    return sequences(t).groupBy("lang", bits.cast("long").alias("key")).agg(F.count("*").alias("n"))


def _hits(t: Tables) -> DataFrame:
    return calls(t).groupBy(F.concat(F.lit("asm"), "sample").alias("query_asm"), F.col("contig").cast("string").alias("query_contig"), F.col("svtype").alias("type"), "pos", "end").agg(
        F.lit("ref").alias("ref_asm"), F.lit("chr1").alias("ref_contig"), F.max("len").alias("svlen"), F.max("price").alias("block_score"), F.count("*").alias("anchors"), F.lit("0/1").alias("genotype"), F.lit(30.0).alias("gq"), F.lit("NONE").alias("annotation"), F.lit("assembly").alias("query_mode")
    )


_HITS = """c AS (SELECT 'asm' || l_suppkey AS query_asm, l_orderkey::VARCHAR AS query_contig, CASE l_returnflag WHEN 'A' THEN 'DEL' WHEN 'N' THEN 'INS' ELSE 'INV' END AS type, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS pos,
    l_quantity::BIGINT AS len, l_extendedprice AS price FROM lineitem),
    h AS (SELECT query_asm, query_contig, type, pos, pos + len AS "end", max(len) AS svlen, count(*) AS anchors FROM c GROUP BY ALL)"""


@query(f"""WITH {_HITS}, d AS (SELECT query_contig, type, pos, "end", max(svlen) AS svlen FROM h GROUP BY ALL) SELECT type, count(*) AS n, sum(svlen)::BIGINT AS bases FROM d GROUP BY type""")
def hits_roundtrip(t: Tables) -> DataFrame:
    """Hits written as TSV and read again, one row of a contig, place and type."""
    path = scratch_path(t.spark, "hits")
    tables.write_hits(_hits(t), path)
    return tables.read_hits(t.spark, path).groupBy("type").agg(F.count("*").alias("n"), F.sum("svlen").alias("bases"))


@query(f"""WITH {_HITS} SELECT type AS svtype, count(*) AS n, sum(CASE type WHEN 'DEL' THEN -svlen ELSE svlen END)::BIGINT AS svlen_sum FROM h GROUP BY type""")
def vcf_roundtrip(t: Tables) -> DataFrame:
    """Calls written as VCF and read again, with normalised lengths."""
    path = scratch_path(t.spark, "vcf")
    tables.write_vcf(_hits(t), path)
    return tables.read_vcf(t.spark, path).groupBy("svtype").agg(F.count("*").alias("n"), F.sum("svlen").alias("svlen_sum"))


@query(f"""WITH {_HITS}, k AS (SELECT count(*) AS n FROM h) SELECT 'H' AS kind, 1 AS n UNION ALL SELECT 'S', n + 1 FROM k UNION ALL SELECT 'L', 2 * n FROM k UNION ALL SELECT 'P', n FROM k""")
def gfa_lines(t: Tables) -> DataFrame:
    """GFA lines of all calls, counted by kind."""
    return tables.gfa_lines(_hits(t)).groupBy(F.substring("value", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


_WILSON = "(tp / n + 3.8416 / (2 * n) {0} 1.96 * sqrt(tp / n * (1 - tp / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"


@query(
    f"""WITH RECURSIVE r AS (SELECT l_orderkey AS contig, CASE l_returnflag WHEN 'A' THEN 'DEL' WHEN 'N' THEN 'INS' ELSE 'INV' END AS svtype, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS pos, l_quantity::BIGINT AS len, l_linestatus AS status FROM lineitem),
    c AS (SELECT *, contig * 10000000000 + pos * 1000000 + len * 1000 + CASE svtype WHEN 'DEL' THEN 100 WHEN 'INS' THEN 200 ELSE 300 END + CASE status WHEN 'O' THEN 1 ELSE 2 END AS id FROM (SELECT DISTINCT contig, pos, pos + len AS "end", svtype, len, status FROM r)),
    p AS (SELECT t.contig, t.svtype, t.id AS tid, p.id AS cid, CASE WHEN p.pos <= t.pos AND t."end" <= p."end" THEN 0 ELSE abs(t.pos - p.pos) END + abs(t.len - p.len) AS d FROM c t JOIN c p ON t.contig = p.contig AND t.svtype = p.svtype AND t.status = 'O' AND p.status = 'F'
      WHERE (abs(t.pos - p.pos) <= CASE t.svtype WHEN 'INS' THEN 500 WHEN 'DEL' THEN 2500 ELSE 10000 END AND abs(t.len - p.len) <= CASE t.svtype WHEN 'INS' THEN 0.3 WHEN 'DEL' THEN 0.1 ELSE 1 END * greatest(t.len, 1)) OR (t.svtype IN ('INV', 'DEL') AND p.pos <= t.pos AND t."end" <= p."end" AND (t.svtype = 'INV' OR p.len >= 2 * t.len))),
    o AS (SELECT *, row_number() OVER (PARTITION BY contig, svtype ORDER BY d, tid, cid) AS k FROM p),
    g AS (SELECT contig, svtype, 0::BIGINT AS k, []::BIGINT[] AS used, false AS took FROM (SELECT DISTINCT contig, svtype FROM o)
      UNION ALL SELECT g.contig, g.svtype, o.k, CASE WHEN NOT list_contains(g.used, o.tid) AND NOT list_contains(g.used, o.cid) THEN list_concat(g.used, [o.tid, o.cid]) ELSE g.used END, NOT list_contains(g.used, o.tid) AND NOT list_contains(g.used, o.cid) FROM g JOIN o ON o.contig = g.contig AND o.svtype = g.svtype AND o.k = g.k + 1),
    m AS (SELECT svtype, count(*) AS tp FROM g WHERE took GROUP BY svtype), n AS (SELECT svtype, count(*) FILTER (WHERE status = 'O') AS truth_calls, count(*) FILTER (WHERE status = 'F') AS pred_calls FROM c GROUP BY svtype),
    s AS (SELECT coalesce(svtype, 'ALL') AS svtype, sum(coalesce(tp, 0))::BIGINT AS tp, sum(truth_calls)::BIGINT AS truth_calls, sum(pred_calls)::BIGINT AS pred_calls FROM n LEFT JOIN m USING (svtype) GROUP BY ROLLUP (svtype)),
    f AS (SELECT *, pred_calls AS n, pred_calls - tp AS fp, truth_calls - tp AS fn, tp / pred_calls AS precision, tp / truth_calls AS recall FROM s)
    SELECT svtype, tp, fp, fn, truth_calls, pred_calls, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, greatest(0, {_WILSON.format('-')}) AS prec_lo95, least(1, {_WILSON.format('+')}) AS prec_hi95, 'ok' AS status FROM f"""
)
def callset_scores(t: Tables) -> DataFrame:
    """Truth and predicted calls matched one to one by type, place, length and span, against a recursion over sorted pairs."""
    c = calls(t).groupBy("contig", "pos", "end", "svtype", "status").agg(F.max("len").alias("svlen"))
    kind = F.when(F.col("svtype") == "DEL", 100).when(F.col("svtype") == "INS", 200).otherwise(300)
    row = F.col("contig") * F.lit(10_000_000_000) + F.col("pos") * 1_000_000 + F.col("svlen") * 1000 + kind + F.when(F.col("status") == "O", 1).otherwise(2)
    rows = c.select(row.alias("id"), F.lit("q").alias("query_asm"), F.col("contig").cast("string").alias("contig"), "pos", "end", "svtype", "svlen", F.lit("query").alias("coord_space"), F.lit(None).cast("string").alias("mate_contig"), F.lit(None).cast("long").alias("mate_pos"), "status")
    return evaluation.score_callsets(rows.filter("status = 'O'").drop("status"), rows.filter("status = 'F'").drop("status"))


@query("SELECT l_returnflag AS kind, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def fnv_hashed_parts(t: Tables) -> DataFrame:
    """Distinct parts by FNV-1a hashes of their numbers: the hash is exact where it doesn't collide."""
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("kind"), "l_partkey").agg(F.count("*").alias("c"))
    hashed = rows.withColumn("h", stats.fnv1a_hash(F.col("l_partkey").cast("string")))
    return hashed.groupBy("kind").agg(F.sum("c").alias("n"), F.count_distinct("h").alias("parts"))
