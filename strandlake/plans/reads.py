"""Queries that bind sources, read filters and sequence functions to whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import evidence as E
from strandlake.functions import scores as S
from strandlake.functions import sequence as Q
from strandlake.functions import stats
from strandlake.operators import biology, callers, detectors, elements, graph, lookup, routing, sketch
from strandlake.plans.calls import taxonomy
from strandlake.plans.documents import _POSTINGS, _SEQ_CTE, SEQ, _digits, sequences
from strandlake.plans.registry import Tables, query
from strandlake.session import scratch_path
from strandlake.sources import sequences as files
from strandlake.sources import tables
from strandlake.streaming import incremental


@query(f"WITH {_SEQ_CTE} SELECT doc_id::VARCHAR AS contig, length(seq) AS n, md5(seq) AS digest FROM s WHERE length(seq) >= 100 AND length(seq) <= 40000")
def fasta_roundtrip(t: Tables) -> DataFrame:
    """Sequences written as FASTA, read again in parts, sanitised and kept within a length band."""
    path = scratch_path(t.spark, "fasta")
    files.write_fasta(sequences(t).select(F.col("doc_id").cast("string").alias("contig"), "seq").filter("seq != ''"), path)
    rows = files.read_fasta_split(t.spark, path).withColumn("ordinal", F.lit(0).cast("long"))
    loaded = files.read_loaded(rows, 100, 40_000)
    return loaded.select("contig", F.length("seq").alias("n"), F.md5("seq").alias("digest"))


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split(upper(regexp_replace(text, '[^ -~]', '', 'g')), ' ')) AS word FROM documents),
    l AS (SELECT doc_id, length(word) < 5 OR len(list_distinct(string_split(word, ''))) <= 1 OR len(list_distinct([substr(word, i, 5) FOR i IN range(1, length(word) - 3)])) < 4 AS low FROM w)
    SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE low) AS low FROM l GROUP BY doc_id"""
)
def low_complexity_reads(t: Tables) -> DataFrame:
    """Words as reads: short, of one letter, or of under four distinct 5-mers (all three rules)."""
    words = t.documents.select("doc_id", F.explode(F.split(F.upper(F.regexp_replace("text", "[^ -~]", "")), " ")).alias("word"))
    return words.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(Q.low_complexity(F.col("word"))).alias("low"))


@query(
    f"""WITH {_SEQ_CTE}, o AS (SELECT doc_id, f, seq, (length(seq) - f) // 3 AS n FROM s, (VALUES (0), (1), (2)) AS v(f)),
    g AS (SELECT doc_id, abs(len(list_filter([substr(seq, i * 3 + f + 3, 1) FOR i IN range(0, n)], lambda b: b IN ('G', 'C'))) / n - 0.5) AS d FROM o WHERE n > 30)
    SELECT s.doc_id, round(coalesce(max(d), 0), 6) AS skew FROM s LEFT JOIN g ON s.doc_id = g.doc_id GROUP BY s.doc_id"""
)
def gc3_skews(t: Tables) -> DataFrame:
    """The largest distance of a frame's third-position GC from one half."""
    return sequences(t).select("doc_id", F.round(Q.gc3_skew(F.col("seq"), F.lit(0.5)), 6).alias("skew"))


_HOST = "ACGTTGCAAGGCTTACGATCGATTACCGGTAGCTAACGT" * 4


@query(
    f"""WITH {_SEQ_CTE}, x AS (SELECT doc_id, seq FROM s WHERE length(seq) >= 50 UNION ALL SELECT NULL, '{_HOST}'),
    l AS (SELECT a, b FROM (VALUES ('A'), ('C'), ('G'), ('T')) AS p(a), (VALUES ('A'), ('C'), ('G'), ('T')) AS q(b)),
    c AS (SELECT doc_id, p, count(*) AS c FROM (SELECT doc_id, substr(seq, unnest(range(1, length(seq))), 2) AS p FROM x) GROUP BY ALL),
    o AS (SELECT x.doc_id, a || b AS p, (length(seq) - length(replace(seq, a, ''))) / length(seq) AS fa, (length(seq) - length(replace(seq, b, ''))) / length(seq) AS fb, length(seq) - 1 AS n FROM x, l),
    r AS (SELECT o.doc_id, o.p, CASE WHEN fa * fb > 0 THEN coalesce(c, 0) / n / (fa * fb) ELSE 0 END AS odds FROM o LEFT JOIN c ON o.doc_id IS NOT DISTINCT FROM c.doc_id AND o.p = c.p)
    SELECT r.doc_id, round(sum(abs(r.odds - h.odds)) * 1000 / 16, 4) AS distance FROM r JOIN r h ON h.doc_id IS NULL AND r.p = h.p WHERE r.doc_id IS NOT NULL GROUP BY r.doc_id"""
)
def karlin_distances(t: Tables) -> DataFrame:
    """Distance of each sequence's dinucleotide odds from a host's."""
    rows = sequences(t).filter(F.length("seq") >= 50)
    return rows.select("doc_id", F.round(Q.karlin_distance(F.col("seq"), F.lit(_HOST)), 4).alias("distance"))


_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


@query(
    f"""WITH {_SEQ_CTE}, a AS (SELECT doc_id, seq, array_to_string([substr('{_CODE}', (16 * (instr('TCAG', substr(seq, i * 3 + 1, 1)) - 1) + 4 * (instr('TCAG', substr(seq, i * 3 + 2, 1)) - 1) + instr('TCAG', substr(seq, i * 3 + 3, 1)))::BIGINT, 1) FOR i IN range(0, length(seq) // 3)], '') AS aa FROM s)
    SELECT doc_id, list_max([length(p) FOR p IN string_split(aa, '*')]) AS longest, md5(substr(seq, 1, 50)) AS excerpt FROM a"""
)
def longest_orfs(t: Tables) -> DataFrame:
    """The longest stretch between stops in the first frame, and the digest of an excerpt."""
    return sequences(t).select("doc_id", Q.longest_orf(F.col("seq")).cast("long").alias("longest"), F.md5(Q.excerpt(F.col("seq"), 50)).alias("excerpt"))


@query(
    f"""WITH {_SEQ_CTE} SELECT doc_id, md5(CASE WHEN length(seq) > 3000 THEN substr(seq, 1, 1000) || substr(seq, ((length(seq) - 1000) // 2 + 1)::BIGINT, 1000) || substr(seq, length(seq) - 999, 1000) ELSE seq END) AS view,
    CASE WHEN length(seq) < 300 THEN 'short' WHEN length(seq) < 2000 THEN 'long' ELSE 'assembly' END AS mode FROM s"""
)
def bounded_views(t: Tables) -> DataFrame:
    """Head, middle and tail of long sequences, and the query mode by length."""
    view = Q.bounded_view(F.col("seq"), 3000, 1000)
    return sequences(t).select("doc_id", F.md5(view).alias("view"), S.detected_mode(F.lit(False), F.length("seq")).alias("mode"))


@query(
    """WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS a FROM documents), p AS (SELECT x.doc_id, x.a, y.a AS b FROM w x JOIN w y ON y.doc_id = x.doc_id + 1)
    SELECT doc_id, round(1 - len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS distance FROM p"""
)
def neighbour_distances(t: Tables) -> DataFrame:
    """Jaccard distance of the word sets of each document and the next."""
    words = t.documents.select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("a"))
    after = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return words.join(after, "doc_id").select("doc_id", F.round(sketch.jaccard_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('3/' || doc_id), doc_id) <= 20")
def reservoir_per_clade(t: Tables) -> DataFrame:
    """A stable sample of twenty documents of each clade (a sampling operator)."""
    return routing.reservoir(t.documents, "lang", "doc_id", 20, 3).select("lang", "doc_id")


@query(
    """WITH d AS (SELECT 'decoy_clade_' || i AS reference, 'DecoyPhylum_' || (i % 16) AS phylum, ['phylum', 'class', 'order', 'family', 'genus', 'species'][i % 6 + 1] AS rank, substr(md5(i || '/' || j || '/7'), 1, 15) AS h FROM range(0, 200) AS a(i), range(1, 9) AS b(j)),
    r AS (SELECT reference, phylum, rank, h FROM d UNION ALL SELECT s_name, 'region', 'species', substr(md5(s_name), 1, 15) FROM supplier)
    SELECT rank, count(*) AS postings, count(*) FILTER (WHERE NOT reference LIKE 'decoy\\_clade\\_%' ESCAPE '\\') AS kept, min(h) AS least FROM r GROUP BY rank"""
)
def decoys_left_out(t: Tables) -> DataFrame:
    """Decoy centroids beside suppliers, and what stays when they are dropped."""
    own = t.supplier.select(F.col("s_name").alias("reference"), F.lit("region").alias("phylum"), F.lit("species").alias("rank"), sketch.hash60(F.col("s_name")).alias("h"))
    rows = routing.decoys(t.spark, 200, 8).unionByName(own)
    kept = routing.without_decoys(rows, "reference").groupBy("rank").agg(F.count("*").alias("kept"))
    return rows.groupBy("rank").agg(F.count("*").alias("postings"), F.min("h").alias("least")).join(kept, "rank", "left").select("rank", "postings", F.coalesce("kept", F.lit(0)).alias("kept"), "least")


@query(
    f"""WITH {_SEQ_CTE}, r AS (SELECT lang, doc_id, length(seq) AS n, sum(length(seq)) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT lang, count(*) AS loaded, sum(n)::BIGINT AS bases FROM r WHERE run <= 20000 OR run = n GROUP BY lang"""
)
def capped_loads(t: Tables) -> DataFrame:
    """Sequences of each clade that a cap of summed length lets in."""
    rows = routing.capped(sequences(t).withColumn("n", F.length("seq").cast("long")), ["lang"], F.col("n"), 20_000, [F.col("doc_id")])
    return rows.groupBy("lang").agg(F.count("*").alias("loaded"), F.sum("n").alias("bases"))


@query(
    f"""WITH {_SEQ_CTE}, {_POSTINGS.format(id='doc_id', k=16, digits=_digits('0'))}, n AS (SELECT id, count(*) AS n FROM p GROUP BY id),
    j AS (SELECT q.id AS query, r.id AS reference, count(*) AS shared FROM p q JOIN p r ON q.h = r.h AND q.id <> r.id WHERE q.id % 100 = 0 GROUP BY ALL),
    c AS (SELECT query, reference, shared / n AS ov, o.lang = d.lang AS same FROM j JOIN n ON n.id = query JOIN documents d ON d.doc_id = reference JOIN documents o ON o.doc_id = query),
    b AS (SELECT query, coalesce(max(ov) FILTER (WHERE same), 0) AS same_overlap, coalesce(max(ov) FILTER (WHERE NOT same), 0) AS other_overlap, (list(reference ORDER BY ov DESC, reference DESC) FILTER (WHERE NOT same))[1] AS other_reference FROM c GROUP BY query)
    SELECT query, round(same_overlap, 6) AS same_overlap, round(other_overlap, 6) AS other_overlap, other_reference,
      CASE WHEN same_overlap < 0.10 AND other_overlap >= 0.08 AND other_overlap - same_overlap >= 0.05 THEN 'HGT_CROSS_CLADE' WHEN greatest(same_overlap, other_overlap) <= 0 THEN 'NOVEL' WHEN greatest(same_overlap, other_overlap) < 0.05 THEN 'NOVEL_WEAK'
      WHEN greatest(same_overlap, other_overlap) < 0.20 THEN 'DIVERGED' ELSE 'OFF_REF_KNOWN' END AS tier FROM b"""
)
def cross_clade_tiers(t: Tables) -> DataFrame:
    """Best overlaps of every hundredth document with its own and with other clades, and the tier they make."""
    p = sketch.postings(sequences(t), "doc_id", "seq", 16, "0")
    named = sequences(t).withColumn("_id", F.struct("doc_id", "lang"))
    every = sketch.postings(named, "_id", "seq", 16, "0").select(F.col("_id.doc_id").alias("reference"), F.col("_id.lang").alias("_lang"), "h")
    # the best of every clade, the largest of equal ones, are all that the best of two groups of clades can be
    near = sketch.best_pairs(p.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "h"), every, 1, "containment", part="_lang", last=True, drop_self=True).drop("_lang")
    clades = t.documents.select(F.col("doc_id").alias("reference"), F.col("lang").alias("clade"))
    own = t.documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("lang").alias("own"))
    found = routing.best_by_clade(near, clades, own)
    return found.select("query", F.round("same_overlap", 6).alias("same_overlap"), F.round("other_overlap", 6).alias("other_overlap"), "other_reference", "tier")


@query(
    f"""WITH {_SEQ_CTE}, {_POSTINGS.format(id='doc_id', k=16, digits=_digits('0'))}, n AS (SELECT id, count(*) AS n FROM p GROUP BY id),
    w0 AS (SELECT doc_id, seq, unnest(CASE WHEN length(seq) <= 2000 THEN [0] ELSE list_distinct(list_concat(range(0, length(seq) - 2000 + 1, 1900), [length(seq) - 2000])) END) AS start FROM s WHERE doc_id % 100 = 0),
    w AS (SELECT doc_id || ':' || start AS query, substr(seq, start + 1, 2000) AS win FROM w0),
    q AS (SELECT DISTINCT query, substr(md5(substr(win, i, 16)), 1, 15) AS h FROM (SELECT *, unnest(range(1, length(win) - 14)) AS i FROM w) ),
    qn AS (SELECT query, count(*) AS n FROM q GROUP BY query), j AS (SELECT query, id AS reference, count(*) AS shared FROM q JOIN p USING (h) GROUP BY ALL)
    SELECT query, reference, shared, round(shared / (qn.n + n.n - shared), 6) AS jaccard, 1 AS rank FROM j JOIN qn USING (query) JOIN n ON n.id = reference
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(shared / (qn.n + n.n - shared), 6) DESC, reference) = 1"""
)
def routed_windows(t: Tables) -> DataFrame:
    """Overlapping windows of every hundredth document, each routed to its nearest document by itself."""
    p = sketch.postings(sequences(t), "doc_id", "seq", 16, "0").select(F.col("doc_id").alias("reference"), "h")
    return routing.route_windows(sequences(t).filter("doc_id % 100 = 0"), "doc_id", "seq", p, 2000, 100, 16, 1)


@query(
    f"""WITH {_SEQ_CTE}, b0 AS (SELECT item_id, {SEQ} AS seq FROM benchmark), b AS (SELECT DISTINCT item_id, substr(md5(substr(seq, i, 9)), 1, 15) AS h FROM (SELECT *, unnest(range(1, length(seq) - 7)) AS i FROM b0)),
    w AS (SELECT doc_id, i AS start, substr(seq, i + 1, 250) AS win FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 249, 125)) AS i FROM s WHERE doc_id % 100 = 0)),
    q AS (SELECT DISTINCT doc_id, start, substr(md5(substr(win, i, 9)), 1, 15) AS h FROM (SELECT *, unnest(range(1, 243)) AS i FROM w)), qn AS (SELECT doc_id, start, count(*) AS n FROM q GROUP BY ALL),
    j AS (SELECT doc_id, start, item_id, count(*) AS shared FROM q JOIN b USING (h) GROUP BY ALL), o AS (SELECT doc_id, start, max(shared / n) AS ov FROM j JOIN qn USING (doc_id, start) GROUP BY ALL),
    c AS (SELECT w.doc_id, w.start, coalesce(ov, 0) AS ov, CASE WHEN coalesce(ov, 0) <= 0 THEN 'NOVEL' WHEN ov < 0.05 THEN 'NOVEL_WEAK' WHEN ov < 0.20 THEN 'DIVERGED' ELSE 'K' END AS tier FROM w LEFT JOIN o USING (doc_id, start)),
    g AS (SELECT *, CASE WHEN lag(tier) OVER x = tier AND lag(start) OVER x + 250 >= start THEN 0 ELSE 1 END AS new FROM c WHERE tier <> 'K' WINDOW x AS (PARTITION BY doc_id ORDER BY start)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT doc_id, min(start) AS start, max(start) + 250 AS "end", round(max(ov), 6) AS overlap, tier FROM i GROUP BY doc_id, island, tier HAVING NOT (tier = 'NOVEL_WEAK' AND count(*) = 1)"""
)
def off_reference_stretches(t: Tables) -> DataFrame:
    """Stretches of every hundredth document that no benchmark item explains."""
    items = sketch.postings(t.benchmark.select("item_id", Q.dna_projection(F.col("text")).alias("seq")), "item_id", "seq", 9).select(F.col("item_id").alias("reference"), "h")
    found = detectors.off_reference_intervals(sequences(t).filter("doc_id % 100 = 0"), "doc_id", "seq", items)
    return found.select("doc_id", "start", "end", F.round("overlap", 6).alias("overlap"), "tier")


@query(
    """WITH k AS (SELECT lang, doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT) AS key FROM documents),
    g AS (SELECT *, CASE WHEN bit_count(xor(key, lag(key) OVER (PARTITION BY lang ORDER BY key, doc_id))) > 4 THEN 1 ELSE 0 END AS far FROM k),
    i AS (SELECT *, sum(far) OVER (PARTITION BY lang ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
    p AS (SELECT *, (row_number() OVER (PARTITION BY lang, island ORDER BY key, doc_id) - 1) // 3 AS part FROM i)
    SELECT lang, island::BIGINT AS island, part, count(*) AS n, min(doc_id) AS first FROM p GROUP BY ALL"""
)
def subclade_islands(t: Tables) -> DataFrame:
    """Islands of near bit keys in each clade, split above three rows."""
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("long")
    found = graph.subclades(t.documents.select("lang", "doc_id", key.alias("key")), "lang", "key", 4, 3)
    return found.groupBy("lang", "island", "part").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(
    """WITH n AS (SELECT n_nationkey AS i, n_regionkey AS r FROM nation)
    SELECT 'n' || a.i AS a, 'n' || b.i AS b, CASE WHEN a.i = b.i THEN 'n' || a.i WHEN a.r = b.r THEN 'r' || a.r ELSE 'root' END AS branch_point FROM n a, n b WHERE (a.i + b.i) % 5 = 0"""
)
def branch_points(t: Tables) -> DataFrame:
    """The lowest common ancestor of pairs of nations in the tree of nations, regions and a root."""
    edges = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).union(t.region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root")))
    up = graph.ancestors(edges, "child", "parent")
    one, two = t.nation.select(F.col("n_nationkey").alias("i")), t.nation.select(F.col("n_nationkey").alias("j"))
    pairs = one.withColumn("m", F.pmod(-F.col("i"), F.lit(5))).join(two.withColumn("m", F.pmod("j", F.lit(5))), "m").select(F.concat(F.lit("n"), "i").alias("a"), F.concat(F.lit("n"), "j").alias("b"))
    return graph.lowest_common(pairs, up, "a", "b")


@query(
    """SELECT s, CASE WHEN h >= 9223372036854775808 THEN (h - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS h FROM (SELECT s, list_reduce(list_prepend(14695981039346656037::HUGEINT, [ord(c)::HUGEINT FOR c IN string_split(s, '')]), lambda a, b: (xor(a::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h
    FROM (SELECT DISTINCT p_type AS s FROM part))"""
)
def fnv_values(t: Tables) -> DataFrame:
    """FNV-1a of each part type, by value."""
    return t.part.select(F.col("p_type").alias("s")).distinct().select("s", stats.fnv1a_hash(F.col("s")).alias("h"))


@query("""SELECT s_nationkey % 7 AS k, s_suppkey AS at, s_nationkey + 1 AS w, lag(s_suppkey) OVER x AS predecessor, lead(s_suppkey) OVER x AS successor, sum(s_nationkey + 1) OVER (x ROWS UNBOUNDED PRECEDING)::BIGINT AS prefix_sum FROM supplier WINDOW x AS (PARTITION BY s_nationkey % 7 ORDER BY s_suppkey)""")
def order_statistics_of_suppliers(t: Tables) -> DataFrame:
    """Predecessors, successors and prefix sums."""
    rows = t.supplier.select((F.col("s_nationkey") % 7).alias("k"), F.col("s_suppkey").alias("at"), (F.col("s_nationkey") + 1).alias("w"))
    return biology.order_statistics(rows, ["k"], "at", "w")


@query("WITH r AS (SELECT user_id, event_id, sum(CASE WHEN value > 50 THEN 2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) SELECT user_id, min(event_id) AS event_id FROM r WHERE run >= 12 GROUP BY user_id")
def kth_events(t: Tables) -> DataFrame:
    """The event at which each user's running weight reaches twelve."""
    rows = t.events.select("user_id", "event_id", F.when(F.col("value") > 50, 2).otherwise(1).alias("w"))
    return biology.kth(rows, ["user_id"], "event_id", "w", 12)


@query(
    f"""WITH {_SEQ_CTE} SELECT doc_id, length(substr(seq, 1, length(seq) // 2)) - length(replace(substr(seq, 1, length(seq) // 2), 'G', '')) AS rank, contains(seq, 'A') AND contains(seq, 'C') AND contains(seq, 'G') AS may_hold FROM s"""
)
def letter_ranks(t: Tables) -> DataFrame:
    """Ranks of a letter in the first half, and whether a word's letters all occur."""
    return sequences(t).select("doc_id", E.letter_rank(F.col("seq"), "G", F.floor(F.length("seq") / 2).cast("int")).alias("rank"), E.has_letters(F.col("seq"), F.lit("ACG")).alias("may_hold"))


@query(
    """WITH t AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey)) AS a, list_distinct(list(l_suppkey)) AS b FROM lineitem GROUP BY l_orderkey)
    SELECT k, len(list_intersect([x % 64 FOR x IN a], [x % 64 FOR x IN b])) > 0 AS may, len(list_intersect(a, b)) > 0 AS does FROM t"""
)
def emptiness_prefilter(t: Tables) -> DataFrame:
    """Whether two sets can share a value by bit maps, and whether they do."""
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey").cast("long")).alias("a"), F.collect_set(F.col("l_suppkey").cast("long")).alias("b"))
    return sets.select("k", E.may_share(F.col("a"), F.col("b")).alias("may"), F.arrays_overlap("a", "b").alias("does"))


@query(
    """WITH h AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS a, string_split(coalesce(lead(text) OVER (ORDER BY doc_id), ''), '') AS b FROM documents),
    l AS (SELECT doc_id, list_filter(a, lambda x: x <> '') AS a, list_filter(b, lambda x: x <> '') AS b FROM h), m AS (SELECT *, least(len(a), len(b)) AS n FROM l),
    c AS (SELECT *, coalesce(list_position(list_transform(list_zip(a[1:n], b[1:n]), lambda x: x[1] = x[2]), false) - 1, n) AS head, coalesce(list_position(list_transform(list_zip(list_reverse(a)[1:n], list_reverse(b)[1:n]), lambda x: x[1] = x[2]), false) - 1, n) AS tail0 FROM m),
    e AS (SELECT *, least(tail0, n - head) AS tail FROM c)
    SELECT doc_id, round(CASE WHEN n = 0 THEN 0 WHEN a = b THEN 1 ELSE (head + tail) / (greatest(len(a), len(b)) + least(head, tail)) END, 6) AS similarity FROM e"""
)
def end_similarities(t: Tables) -> DataFrame:
    """Prefix and suffix similarity of each whole document and the next."""
    text = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("a"))
    after = text.select(F.col("doc_id").alias("next"), F.col("a").alias("b"))
    both = text.join(stats.following(text, "doc_id", "next"), "doc_id").join(after, "next", "left")
    return both.select("doc_id", F.round(E.end_similarity(F.col("a"), F.coalesce("b", F.lit(""))), 6).alias("similarity"))


@query(
    """WITH p AS (SELECT p_partkey, p_name, '>' || p_partkey || '#' || replace(p_type, ' ', '/') || ' x' AS header, string_split(p_type, ' ') AS w FROM part)
    SELECT p_partkey::VARCHAR AS id, w[1] AS te_class, CASE WHEN len(w) >= 3 THEN w[2] ELSE '' END AS te_order, w[-1] AS superfamily, w[1] || '/' || CASE WHEN len(w) >= 3 THEN w[2] || '/' ELSE '' END || w[-1] AS centroid FROM p"""
)
def element_labels(t: Tables) -> DataFrame:
    """Labels read from headers, and the centroids that they name."""
    header = F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit("#"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit(" x"))
    rows = t.part.select(E.element_label(header).alias("l"))
    return rows.select("l.id", "l.te_class", "l.te_order", "l.superfamily", E.centroid_name(F.col("l")).alias("centroid"))


@query(
    f"""WITH {_SEQ_CTE}, r AS (SELECT doc_id, lang || '/' || source AS c, seq FROM s), k AS (SELECT c, doc_id, substr(md5(substr(seq, i, 12)), 1, 15) AS h FROM (SELECT *, unnest(range(1, length(seq) - 10)) AS i FROM r)),
    t AS (SELECT c, h FROM (SELECT DISTINCT c, h FROM k WHERE doc_id % 5 <> 0 AND h[1] = '0') QUALIFY row_number() OVER (PARTITION BY c ORDER BY h) <= 256),
    o AS (SELECT doc_id, h FROM (SELECT DISTINCT doc_id, h FROM k WHERE doc_id % 5 = 0 AND h[1] = '0') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h) <= 256),
    tn AS (SELECT c, count(*) AS n FROM t GROUP BY c), ob AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id), j AS (SELECT doc_id, c, count(*) AS shared FROM o JOIN t USING (h) GROUP BY ALL),
    b AS (SELECT doc_id, c, shared / (tn.n + ob.n - shared) AS sim FROM j JOIN tn USING (c) JOIN ob USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared / (tn.n + ob.n - shared) DESC, c) = 1)
    SELECT doc_id::VARCHAR AS id, coalesce(string_split(c, '/')[1], 'Unknown') AS pred_class, CASE WHEN c IS NULL THEN 'Unknown' ELSE '' END AS pred_order, coalesce(string_split(c, '/')[2], 'Unknown') AS pred_superfamily, printf('%.4f', coalesce(sim, 0)) AS jaccard_sim, coalesce(c, '.') AS best_centroid
    FROM documents LEFT JOIN b USING (doc_id) WHERE doc_id % 5 = 0"""
)
def element_predictions(t: Tables) -> DataFrame:
    """Four fifths of the documents train centroids of language and source; the others are classified, written as a table and read again."""
    rows = sequences(t).select("doc_id", F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("#"), "lang", F.lit("/"), "source").alias("header"), "seq")
    model = scratch_path(t.spark, "elements")
    elements.save(elements.train(rows.filter("doc_id % 5 != 0"), "header", "seq", 12, 256, "0"), model)
    asked = rows.filter("doc_id % 5 = 0")
    path = scratch_path(t.spark, "predictions")
    elements.write_predictions(elements.classify(asked, "header", "seq", elements.load(t.spark, model), 12, 256, "0"), path)
    found = tables.read_header_tsv(t.spark, path)
    return found.select(*[F.coalesce(c, F.lit("")).alias(c) for c in elements.PREDICTIONS])


@query(
    """WITH m AS (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS n FROM customer)
    SELECT CASE WHEN n < 3 THEN 'Symbiotroph_arbuscular_mycorrhizal' WHEN n < 6 THEN 'Pathotroph_plant_pathogen' WHEN n < 9 THEN 'Yeast_opportunistic_pathogen' WHEN n < 12 THEN 'Saprotroph_yeast' WHEN n < 15 THEN 'Saprotroph_wood_decay' WHEN seg = 'BUILDING' THEN 'Pathotroph' ELSE '.' END AS ecological_trait, count(*) AS n
    FROM m GROUP BY ALL"""
)
def ecological_traits(t: Tables) -> DataFrame:
    """Ways of life inferred from a made-up taxonomy of customers."""
    n = F.col("c_nationkey")
    pick = lambda low, value: F.when((n >= low) & (n < low + 3), value).otherwise("none")
    meta = t.customer.select(
        F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("query_asm"), F.when((n >= 3) & (n < 6), "Fusarium x").otherwise("odd").alias("species"), F.when((n >= 6) & (n < 9), "Candida").when((n >= 9) & (n < 12), "Pichia").otherwise("none").alias("genus"),
        F.lit(None).cast("string").alias("family"), pick(12, "Agaricales").alias("order"), F.lit(None).cast("string").alias("class"), pick(0, "Glomeromycota").alias("phylum"), F.when(F.col("c_mktsegment") == "BUILDING", "pathogen x").alias("scenario"), F.lit(None).cast("string").alias("lifestyle"),
    )
    nothing = t.spark.createDataFrame([], "species string, genus string, trait_name string, value string")
    species, genus = biology.trait_table(nothing)
    traits = t.spark.createDataFrame([], "alias string, species string")
    return biology.ecological_context(meta, traits, species, genus).groupBy("ecological_trait").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT c_nationkey AS k, c_custkey AS name, 900 + c_custkey % 200 AS n FROM customer), o AS (SELECT k, sum(n) AS bases FROM c GROUP BY k), j AS (SELECT *, bases / 500.0 AS cov, ('0x' || substr(md5(name::VARCHAR), 1, 8))::BIGINT % 1000003 AS x FROM c JOIN o USING (k)),
    l AS (SELECT k, (list(name ORDER BY n DESC, name DESC))[1] AS longest FROM c GROUP BY k)
    SELECT k, count(*) AS kept, sum(n)::BIGINT AS bases FROM j JOIN l USING (k) WHERE x <= floor(CASE WHEN cov > 1.2 * 6 THEN 6 / cov ELSE 1 END * 1000003) OR name = longest GROUP BY k"""
)
def downsampled_to_target(t: Tables) -> DataFrame:
    """Reads of each key thinned to a target coverage, the longest kept (a sampling operator)."""
    reads = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("name"), (F.lit(900) + F.col("c_custkey") % 200).alias("n"))
    return biology.downsampled(reads, "k", "name", "n", F.col("_bases") / 500.0, 6.0).groupBy("k").agg(F.count("*").alias("kept"), F.sum("n").alias("bases"))


@query(
    """SELECT r_name AS phylum, n_name AS clade, count(*) AS entries, min('/x/asm' || s_suppkey || '.fa') AS first FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def manifest_roundtrip(t: Tables) -> DataFrame:
    """A manifest written as text and read again, with a clade of each entry."""
    lines = taxonomy(t).select(F.concat_ws("\t", F.concat(F.lit("asm"), "sample"), "phylum", F.lit("C"), F.lit("O"), F.lit("F"), F.lit("G"), "clade", F.lit("class"), F.concat(F.lit("/x/asm"), "sample", F.lit(".fa"))).alias("value"))
    path = scratch_path(t.spark, "manifest")
    lines.union(t.spark.createDataFrame([("#asm\tphylum",), ("",)], "value string")).write.text(path)
    rows = tables.read_manifest(t.spark, path)
    return rows.groupBy("phylum", F.col("clade_name").alias("clade")).agg(F.count("*").alias("entries"), F.min("fasta_path").alias("first"))


@query("SELECT r_name AS clade_name, count(*) AS genome_count, sum(n_nationkey)::BIGINT AS nodes, list_sort(list(n_nationkey::BIGINT))::VARCHAR AS hashes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def routing_roundtrip(t: Tables) -> DataFrame:
    """A routing manifest written as TSV and read again: numbers are cast, lists become arrays, damaged hashes are skipped."""
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("clade_name")).agg(F.count("*").alias("genome_count"), F.sum("n_nationkey").alias("nodes"), F.concat(F.array_join(F.array_sort(F.collect_list(F.col("n_nationkey").cast("long"))), ","), F.lit(",zz")).alias("centroid_hashes"))
    path = scratch_path(t.spark, "routing")
    tables.write_tsv(named.select(*[F.col(c) if c in named.columns else F.lit("x").alias(c) for c in tables.ROUTING]), path)
    rows = tables.read_routing(t.spark, path)
    return rows.select("clade_name", "genome_count", "nodes", F.concat(F.lit("["), F.array_join(F.array_sort("centroid_hashes"), ", "), F.lit("]")).alias("hashes"))


@query("""SELECT '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS json FROM (SELECT event_type AS k, count(*) AS n FROM events GROUP BY ALL)""")
def summary_of_events(t: Tables) -> DataFrame:
    """A counter as one row of JSON."""
    return tables.summary_json(t.events.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")


@query(
    """WITH g AS (SELECT 'c' || (s_suppkey % 5) AS contig, s_suppkey AS a, s_suppkey + s_nationkey AS b FROM supplier)
    SELECT kind, contig, count(*) AS n, sum("end" - start)::BIGINT AS gaps, min(start) AS first FROM (SELECT 'gff3' AS kind, contig, a AS start, b AS "end" FROM g UNION ALL SELECT 'bed', contig, a + 1, b FROM g WHERE b > a UNION ALL SELECT 'blast6', contig, a, b FROM g) WHERE "end" - start + 1 >= 3 GROUP BY ALL"""
)
def interval_files(t: Tables) -> DataFrame:
    """GFF3, BED and BLAST-6 files written and read as intervals of at least three bases, whatever their strand."""
    g = t.supplier.select(F.concat(F.lit("c"), F.col("s_suppkey") % 5).alias("contig"), F.col("s_suppkey").cast("string").alias("a"), (F.col("s_suppkey") + F.col("s_nationkey")).cast("string").alias("b"))
    nil = F.lit(".")
    lines = {"gff3": F.concat_ws("\t", "contig", nil, nil, "a", "b", nil, nil, nil, nil), "bed": F.concat_ws("\t", "contig", "a", "b"), "blast6": F.concat_ws("\t", "contig", nil, nil, nil, nil, nil, "b", "a", nil, nil, nil, nil)}
    out = None
    for kind, line in lines.items():
        path = scratch_path(t.spark, kind)
        (g.filter("cast(b AS long) > cast(a AS long)") if kind == "bed" else g).select(line.alias("value")).write.text(path)
        rows = tables.read_intervals(t.spark, path, kind, 3).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind", "contig").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("gaps"), F.min("start").alias("first"))


@query(
    """WITH i AS (SELECT n_name AS clade_name, count(*) AS indexed FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), m AS (SELECT n_name AS clade_name, count(*) AS listed FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT clade_name, indexed::BIGINT AS indexed, listed, CASE WHEN indexed IS NOT DISTINCT FROM listed THEN 'ok' ELSE 'check' END AS status FROM i FULL JOIN m USING (clade_name)"""
)
def index_validation(t: Tables) -> DataFrame:
    """Genome counts of an index against a manifest."""
    index = taxonomy(t).groupBy(F.col("clade").alias("clade_name")).agg(F.count("*").alias("genome_count"))
    listed = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("clade_name"))
    return tables.validation_report(index, listed)


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5")
def stream_that_resumes(t: Tables) -> DataFrame:
    """A bounded top-k stream run twice at one path: the second run goes on from the first one's progress and finds nothing new."""
    path = scratch_path(t.spark, "resumed")
    incremental.top_k(t.spark, t.sf_dir, 5, path)
    return incremental.top_k(t.spark, t.sf_dir, 5, path)


@query(f"WITH {_SEQ_CTE} SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(seq) < 1000 OR length(seq) < 0.55 * 4000) AS fragments FROM s GROUP BY lang")
def fragment_reads(t: Tables) -> DataFrame:
    """Reads that cover only a part of their reference."""
    return sequences(t).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(callers.fragments(F.length("seq"), F.lit(4000))).alias("fragments"))


@query(
    """WITH o AS (SELECT s_suppkey AS k, s_name AS a, 'alt ' || s_suppkey AS b FROM supplier) SELECT 'pos' AS name, count(*) AS n, 0 AS nulls FROM o UNION ALL SELECT 'svlen', count(*), 0 FROM o UNION ALL SELECT 'label', count(*), count(*) FROM o"""
)
def harmonised_columns(t: Tables) -> DataFrame:
    """Columns found under other names, derived, or missing."""
    rows = t.supplier.select(F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 4).alias("end"))
    one = biology.harmonised(rows, {"pos": ["start"], "svlen": ["length"], "label": ["tag"]})
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).isNull().alias("missing")) for c in ("pos", "svlen", "label")])).alias("x"))
    return long.groupBy("x.name").agg(F.count("*").alias("n"), F.count_if("x.missing").alias("nulls"))


@query("SELECT s_name AS query_asm, len(list_distinct([s_name || '.fa', s_name])) AS aliases FROM supplier")
def sample_aliases(t: Tables) -> DataFrame:
    """Names under which an assembly file may be known."""
    found = lookup.name_aliases(F.concat("s_name", F.lit(".fa")))
    return t.supplier.select(F.col("s_name").alias("query_asm"), F.size(F.filter(found, lambda a: a.isin(F.col("s_name"), F.concat("s_name", F.lit(".fa"))))).alias("aliases"))
