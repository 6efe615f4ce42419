"""Checks over generated genomes, whose truth is known: callers, bubbles, reads. They read no table, so they are tests and not in the catalog; and the compact graphs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import calling, detectors, graph, sketch, synthetic
from strandlake.plans.documents import _SEQ_CTE, sequences
from strandlake.plans.registry import Tables, query

#: By name: a check and the SQL of what it must give.
PLANTED: dict[str, tuple] = {}


def planted(sql: str):
    """Keeps a check under its own name."""

    def add(function):
        PLANTED[function.__name__] = (function, sql)
        return function

    return add


_N, _LENGTH, _AT = 40, 6400, 3200
_TRUTH = "t AS (SELECT ['INS', 'DEL', 'INV', 'DUP'][i % 4 + 1] AS svtype, [320, 320, 480, 256][i % 4 + 1] AS svlen FROM range(0, 40) AS r(i))"


def _bases(name: str, length: int) -> str:
    """SQL of ``synthetic.bases``."""
    return f"substr(translate(array_to_string([md5({name} || '/' || j) FOR j IN range(1, {-(-length // 32) + 1})], ''), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {length})"


@planted(f"SELECT i AS genome, md5({_bases(chr(39) + '1-' + chr(39) + ' || i', _LENGTH)}) AS digest, {_LENGTH}::BIGINT + [320, -320, 0, 256][i % 4 + 1] AS query_length FROM range(0, {_N}) AS r(i)")
def generated_genomes(t: Tables) -> DataFrame:
    """Generated genomes and the lengths of their versions with a planted event."""
    rows = synthetic.planted(synthetic.genomes(t.spark, _N, _LENGTH), _AT)
    return rows.select("genome", F.md5("reference").alias("digest"), F.length("query").cast("long").alias("query_length"))


def _found(t: Tables, single: bool) -> DataFrame:
    rows = synthetic.planted(synthetic.genomes(t.spark, _N, _LENGTH), _AT).repartition("genome")
    calls = calling.call_rows(rows.select("genome", "query", "reference"), ["genome"], "query", "reference", single=single)
    near = (F.abs(F.abs("c.svlen") - F.col("t.svlen")) <= 0.1 * F.col("t.svlen")) & (F.abs(F.col("c.pos") - _AT) <= 600)
    hit = rows.alias("t").join(calls.alias("c"), (F.col("t.genome") == F.col("c.genome")) & (F.col("t.svtype") == F.col("c.svtype")) & near, "left_semi")
    return rows.groupBy("svtype").agg(F.count("*").alias("planted")).join(hit.groupBy("svtype").agg(F.count("*").alias("found")), "svtype", "left").select("svtype", "planted", F.coalesce("found", F.lit(0)).alias("found"))


@planted(f"WITH {_TRUTH} SELECT svtype, count(*) AS planted, count(*) AS found FROM t GROUP BY svtype")
def planted_events_found(t: Tables) -> DataFrame:
    """Events planted in generated genomes, and those that the chain caller finds at their place and size: all."""
    return _found(t, False)


@planted(f"WITH {_TRUTH} SELECT svtype, count(*) AS planted, count(*) AS found FROM t GROUP BY svtype")
def planted_events_single_reference(t: Tables) -> DataFrame:
    """The same for the caller of many chains against a single reference."""
    return _found(t, True)


@planted(f"SELECT i AS genome, count(*) AS reads, count(*) FILTER (WHERE (s // 200) % 2 = 1) AS turned FROM range(0, {_N}) AS r(i), range(0, {_LENGTH} - 800 + 1, 200) AS w(s) GROUP BY i")
def generated_reads(t: Tables) -> DataFrame:
    """Reads of generated genomes: every other one comes from the other strand."""
    rows = synthetic.genomes(t.spark, _N, _LENGTH)
    found = synthetic.reads(rows, "genome", "reference", 800, 200).join(rows, "genome")
    return found.groupBy("genome").agg(F.count("*").alias("reads"), F.count_if(~F.contains("reference", F.col("read"))).alias("turned"))


#: Whether segments x and y share half of their 15-mers, or nearly all by their ends.
_ALIKE = """(len(list_intersect({x}.w, {y}.w)) > 0 AND len(list_intersect({x}.w, {y}.w)) >= 0.5 * (len({x}.w) + len({y}.w) - len(list_intersect({x}.w, {y}.w)))) OR {ends} >= 0.85"""
_HEAD = "coalesce(list_position([substr({x}.seq, i, 1) = substr({y}.seq, i, 1) FOR i IN range(1, least(length({x}.seq), length({y}.seq)) + 1)], false) - 1, least(length({x}.seq), length({y}.seq)))"
_TAIL = "least(coalesce(list_position([substr({x}.seq, length({x}.seq) - i + 1, 1) = substr({y}.seq, length({y}.seq) - i + 1, 1) FOR i IN range(1, least(length({x}.seq), length({y}.seq)) + 1)], false) - 1, least(length({x}.seq), length({y}.seq))), least(length({x}.seq), length({y}.seq)) - {head})"


def _alike(x: str, y: str) -> str:
    head = _HEAD.format(x=x, y=y)
    tail = _TAIL.format(x=x, y=y, head=head)
    ends = f"(CASE WHEN {x}.seq = {y}.seq THEN 1 ELSE ({head} + {tail}) / (greatest(length({x}.seq), length({y}.seq)) + least({head}, {tail})) END)"
    return _ALIKE.format(x=x, y=y, ends=ends)


@query(
    f"""WITH RECURSIVE l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT DISTINCT lang, line FROM l WHERE length(line) >= 40 AND lang IS NOT NULL),
    n AS (SELECT lang, line AS seq, substr(md5(lang || '|' || line), 1, 16) AS own, lang || '|' || md5(line) AS key, list_distinct([substr(line, i, 15) FOR i IN range(1, length(line) - 13)]) AS w, concat_ws('|', lang, length(line) // 250, substr(line, 1, 12), right(line, 12)) AS bucket FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, own) AS k FROM n),
    g AS (SELECT bucket, k, own, own AS node, [{{'node': own, 'seq': seq, 'w': w}}] AS kept FROM o WHERE k = 1
      UNION ALL SELECT bucket, k, own, coalesce(hit.node, own), CASE WHEN hit IS NULL THEN list_append(kept, {{'node': own, 'seq': seq, 'w': w}}) ELSE kept END
      FROM (SELECT o.bucket, o.k, o.own, o.seq, o.w, g.kept, list_filter(g.kept, lambda x: {_alike('x', 'o')})[1] AS hit FROM g JOIN o ON o.bucket = g.bucket AND o.k = g.k + 1))
    SELECT lang, own AS segment, node FROM g JOIN o USING (bucket, k, own)"""
)
def collapsed_segments(t: Tables) -> DataFrame:
    """The node of each distinct line of a clade: the first line before it that is alike, or itself; against a recursion over the lines of each bucket."""
    rows = t.documents.select("lang", F.explode(F.split("text", "\n")).alias("line")).filter("length(line) >= 40 AND lang IS NOT NULL").distinct()
    keyed = rows.select(F.concat_ws("|", "lang", F.md5("line")).alias("key"), "lang", "line", F.lit(False).alias("rep"))
    nodes = graph.collapsed(keyed, "key", "line", "lang", "rep")
    return keyed.join(nodes, "key").select("lang", F.substring(F.md5(F.concat_ws("|", "lang", "line")), 1, 16).alias("segment"), "node")


@query(
    f"""WITH {_SEQ_CTE}, r AS (SELECT lang, substr(seq, 1, 512) AS seed FROM s WHERE seq <> '' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('0/' || doc_id), doc_id) <= 64)
    SELECT lang, md5(seed) AS node, count(*) AS support, row_number() OVER (PARTITION BY lang ORDER BY md5(seed)) AS number FROM r GROUP BY lang, md5(seed)"""
)
def compact_graphs(t: Tables) -> DataFrame:
    """Nodes of compact graphs: distinct seeds of a reservoir of each clade (a sampling operator)."""
    return graph.compact_graph(sequences(t), "lang", "doc_id", "seq")


@planted("SELECT i AS genome, true AS postings_equal FROM range(0, 40) AS r(i)")
def minimizer_postings_of_both_strands(t: Tables) -> DataFrame:
    """Canonical minimizers: a genome and its other strand have the same postings."""
    from strandlake.functions import sequence as Q

    rows = synthetic.genomes(t.spark, _N, _LENGTH)
    one = detectors.minimizer_postings(rows, "genome", "reference").groupBy("genome").agg(F.array_sort(F.collect_set("hash")).alias("a"))
    two = detectors.minimizer_postings(rows.withColumn("reference", Q.reverse_complement(F.col("reference"))), "genome", "reference").groupBy("genome").agg(F.array_sort(F.collect_set("hash")).alias("b"))
    return one.join(two, "genome").select("genome", ((F.col("a") == F.col("b")) & (F.size("a") > 20)).alias("postings_equal"))


@planted("SELECT i AS genome, i AS nearest FROM range(0, 40) AS r(i)")
def genomes_routed_home(t: Tables) -> DataFrame:
    """Versions with planted events are routed to the genome that they come from."""
    rows = synthetic.planted(synthetic.genomes(t.spark, _N, _LENGTH), _AT)
    p = sketch.postings(rows, "genome", "query", 16, "01").select(F.col("genome").alias("query"), "h")
    near = sketch.route_topk(p, sketch.postings(rows, "genome", "reference", 16, "01").select(F.col("genome").alias("reference"), "h"), 1, False)
    return near.select(F.col("query").alias("genome"), F.col("reference").alias("nearest"))
