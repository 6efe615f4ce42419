"""Queries over events, labels, embeddings and conversations: statistics, paths, graphs, streams' final states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import scores as S
from strandlake.functions import stats
from strandlake.plans.registry import Tables, query
from strandlake.streaming import incremental

_P = "p AS (SELECT event_id, user_id % 50 AS family, round(abs(value) / 100 - floor(abs(value) / 100), 6) AS p FROM events)"


def _p_values(t: Tables) -> DataFrame:
    x = F.abs("value") / 100
    return t.events.select("event_id", (F.col("user_id") % 50).alias("family"), F.round(x - F.floor(x), 6).alias("p"))


@query(
    f"""WITH {_P}, r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, count(*) OVER (PARTITION BY family ORDER BY p) AS rank FROM p)
    SELECT event_id, family, p, round(least(1, min(p * m / rank) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM r"""
)
def bh_adjust(t: Tables) -> DataFrame:
    """Benjamini-Hochberg in families."""
    out = stats.benjamini_hochberg(_p_values(t), "p", "q", ["family"])
    return out.select("event_id", "family", "p", F.round("q", 9).alias("q"))


_TABLE = """c AS (SELECT source, count(*) FILTER (WHERE toxic = 1) AS a, count(*) FILTER (WHERE toxic = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY source),
    t AS (SELECT source, a, b, sum(a) OVER () - a AS c, sum(b) OVER () - b AS d, count(*) OVER () AS n FROM c)"""


def _tables(t: Tables) -> DataFrame:
    """A 2x2 table of each source against all others."""
    counts = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("n"))
    # one row of totals
    return counts.join(F.broadcast(total), F.lit(True)).select("source", "a", "b", (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d"), "n")


@query(f"WITH {_TABLE} SELECT source, a, b, c::BIGINT AS c, d::BIGINT AS d, round(((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)), 6) AS odds FROM t")
def odds_ratio_haldane(t: Tables) -> DataFrame:
    """Odds ratios with half a count in each cell."""
    return _tables(t).select("source", "a", "b", "c", "d", F.round(S.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("odds"))


_FISHER = """f AS (SELECT source, n, sum(exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1)
      - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)))) AS p
    FROM (SELECT *, unnest(range(a, (least(a + b, a + c) + 1)::BIGINT)) AS x FROM t) GROUP BY source, n)"""


@query(f"WITH {_TABLE}, {_FISHER} SELECT source, round(least(1, p), 6) AS p, round(least(1, p * n), 6) AS bonferroni FROM f")
def fisher_right(t: Tables) -> DataFrame:
    """Right-tailed Fisher tests of each source, with Bonferroni's correction."""
    p = _tables(t).select("source", "n", stats.fisher_right("a", "b", "c", "d").alias("p"))
    return p.select("source", F.round("p", 6).alias("p"), F.round(F.least(F.lit(1.0), F.col("p") * F.col("n")), 6).alias("bonferroni"))


@query(
    """WITH k AS (SELECT source, count(*) FILTER (WHERE quality = 0) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
    SELECT source, k, n, round(CASE WHEN k = 0 THEN 1 ELSE least(1, (SELECT sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(0.15) + (n - x) * ln(0.85))) FROM unnest(range(k, n + 1)) AS u(x))) END, 6) AS p FROM k"""
)
def binomial_tail(t: Tables) -> DataFrame:
    """Upper binomial tails of low-quality counts."""
    k = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("k"), F.count("*").alias("n"))
    return k.select("source", "k", "n", F.round(stats.binomial_tail("k", "n", F.lit(0.15)), 6).alias("p"))


@query()
def welch_normal(t: Tables) -> DataFrame:
    """Welch tests between event types of each user group."""
    s = t.events.groupBy((F.col("user_id") % 20).alias("grp"), "event_type").agg(F.avg("value").alias("m"), stats.sample_variance(F.col("value")).alias("v"), F.count("*").alias("n"))
    b = s.select("grp", F.col("event_type").alias("other"), F.col("m").alias("m2"), F.col("v").alias("v2"), F.col("n").alias("n2"))
    both = s.join(b, "grp").filter(F.col("event_type") < F.col("other"))
    return both.select("grp", "event_type", "other", F.round(stats.welch("m", "v", "n", "m2", "v2", "n2"), 9).alias("p"))


@query(
    """WITH g AS (SELECT user_id, event_id, ts, value, date_diff('second', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT user_id, island::BIGINT AS island, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS total FROM s GROUP BY ALL"""
)
def observation_islands(t: Tables) -> DataFrame:
    """Runs of observations without a long pause (consecutive-run detection)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))) - F.unix_timestamp(F.date_trunc("second", F.lag("ts").over(w).cast("timestamp")))
    rows = t.events.withColumn("gap", gap)
    rows = rows.withColumn("island", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 1800), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, event_id, value - lag(value) OVER w AS jump, lead(value, 2) OVER w - value AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) FILTER (WHERE jump < -20) AS back_jumps, count(*) FILTER (WHERE jump < -20 AND ahead * 2 < -jump) AS coherent, bool_or(jump < 0) AS non_monotone FROM g GROUP BY user_id"""
)
def backward_jumps(t: Tables) -> DataFrame:
    """Backward jumps along a path, and those that the successor confirms."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = t.events.select("user_id", (F.col("value") - F.lag("value").over(w)).alias("jump"), (F.lead("value", 2).over(w) - F.col("value")).alias("ahead"))
    back = F.col("jump") < -20
    return g.groupBy("user_id").agg(F.count_if(back).alias("back_jumps"), F.count_if(back & (F.col("ahead") * 2 < -F.col("jump"))).alias("coherent"), F.bool_or(F.col("jump") < 0).alias("non_monotone"))


@query(
    """WITH e AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations)
    SELECT role AS from_role, next_role AS to_role, count(*) AS n, count(DISTINCT conv_id) AS paths FROM e WHERE next_turn IS NOT NULL GROUP BY ALL"""
)
def clade_graph_edges(t: Tables) -> DataFrame:
    """Edges between consecutive nodes of paths, with support."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    e = t.conversations.select("conv_id", F.col("role").alias("from_role"), F.lead("role").over(w).alias("to_role"), F.lead("turn").over(w).alias("next_turn"))
    return e.filter("next_turn IS NOT NULL").groupBy("from_role", "to_role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("paths"))


@query(
    """WITH c AS (SELECT conv_id, turn, substr(md5(text), 1, 4) AS node, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT coalesce(prev, '^') AS prev, coalesce(next, '$') AS next, count(DISTINCT node) AS nodes, count(*) AS support FROM c GROUP BY ALL HAVING count(DISTINCT node) > 1"""
)
def bubble_contexts(t: Tables) -> DataFrame:
    """Contexts with more than one node between them: bubbles."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select(F.substring(F.md5("text"), 1, 4).alias("node"), F.coalesce(F.lag("role").over(w), F.lit("^")).alias("prev"), F.coalesce(F.lead("role").over(w), F.lit("$")).alias("next"))
    return c.groupBy("prev", "next").agg(F.count_distinct("node").alias("nodes"), F.count("*").alias("support")).filter("nodes > 1")


@query(
    """WITH a AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM conversations)
    SELECT conv_id, count(*) FILTER (WHERE role <> 'user') AS inside, max(turn - anchor) AS widest FROM a GROUP BY conv_id"""
)
def path_bubbles(t: Tables) -> DataFrame:
    """Steps of a path since its last anchor."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    a = t.conversations.withColumn("anchor", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w))
    return a.groupBy("conv_id").agg(F.count_if(F.col("role") != "user").alias("inside"), F.max(F.col("turn") - F.col("anchor")).alias("widest"))


@query(
    """WITH d AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) SELECT label, i, count(*) AS n, round(avg(x::DOUBLE), 6) AS centre FROM d GROUP BY ALL"""
)
def centroid_vectors(t: Tables) -> DataFrame:
    """Centroids by label, coordinate by coordinate."""
    d = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    return d.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("centre"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, epoch_ms(time_bucket(INTERVAL '1 hour', ts)) // 1000 AS window_start FROM events GROUP BY ALL")
def stream_window_counts(t: Tables) -> DataFrame:
    """Tumbling counts by event time: the final state of the streaming query, run as a stream over the table."""
    found = incremental.window_counts(incremental.stream(t.spark, t.sf_dir, "events"), "1 hour")
    out = incremental.finished(found, "window_counts", "complete")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), F.unix_timestamp("start").alias("window_start"))


@query("SELECT user_id, round(value, 2) AS value_bin, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL")
def stream_dedup(t: Tables) -> DataFrame:
    """De-duplication of repeated observations as they arrive: the final state of the stream."""
    found = incremental.best_per_key(incremental.stream(t.spark, t.sf_dir, "events"))
    return incremental.finished(found, "stream_dedup", "complete")


@query("SELECT event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5")
def stream_topk(t: Tables) -> DataFrame:
    """The five largest values of each type over a stream, with bounded state."""
    return incremental.top_k(t.spark, t.sf_dir, 5)
