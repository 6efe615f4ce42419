"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import staged


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hooks each node's neighbours (the larger ones, or the smaller ones and itself) to the smallest of them."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b"), F.col("a"))) if large else pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    near = both.filter("v > u") if large else both
    linked = near.join(least, near.u == least.k).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.union(least.select(F.col("k"), F.col("m")))
    return linked.filter("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (a, b: long); root is the smallest node that it reaches.

    Each round is written to the shared folder. Links of a node to itself and repeated links do no harm.
    """
    pairs = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    mark = None
    for _ in range(most_rounds):
        found = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        pairs = staged(_star(_star(pairs, True), False), "stars")
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(pairs.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
