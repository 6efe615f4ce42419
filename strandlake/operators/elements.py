"""Element classification: labelled sequences make a centroid of each superfamily, others get the nearest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import evidence as E
from strandlake.operators import sketch
from strandlake.operators.selection import top_per_key
from strandlake.session import staged

#: The columns of the prediction table.
PREDICTIONS = ("id", "pred_class", "pred_order", "pred_superfamily", "jaccard_sim", "best_centroid")


def train(records: DataFrame, header: str, seq: str, k: int = 12, most: int = 4096, keep_digit: str = "") -> DataFrame:
    """Centroids (centroid, h) of the labelled records: the ``most`` smallest hashes of all k-mers of a superfamily."""
    labelled = records.withColumn("_l", E.element_label(F.col(header))).filter("_l.labelled").select(E.centroid_name(F.col("_l")).alias("centroid"), F.upper(seq).alias("seq"))
    return sketch.bottom_of(labelled, "centroid", "seq", k, most, keep_digit)


def save(centroids: DataFrame, path: str) -> None:
    """A trained model is a table of its centroids' hashes."""
    centroids.write.mode("overwrite").partitionBy("centroid").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("partitionInferTypes", "false").parquet(path).select(F.col("centroid").cast("string").alias("centroid"), "h")


def classify(records: DataFrame, header: str, seq: str, centroids: DataFrame, k: int = 12, most: int = 4096, keep_digit: str = "") -> DataFrame:
    """The nearest centroid of each record by the Jaccard similarity of their smallest hashes; 'Unknown' where none shares a hash."""
    named = records.select(E.element_label(F.col(header))["id"].alias("id"), F.upper(seq).alias("seq"))
    own = sketch.bottom_of(named, "id", "seq", k, most, keep_digit)
    near = sketch.similarities(centroids.select(F.col("centroid").alias("query"), "h"), own.select(F.col("id").alias("reference"), "h"))
    best = top_per_key(near, ["reference"], [F.col("jaccard").desc(), F.col("query")]).select(F.col("reference").alias("id"), F.col("query").alias("best_centroid"), "jaccard")
    found = named.select("id").distinct().join(staged(best, "nearest"), "id", "left")
    parts = F.split("best_centroid", "/")
    unknown = F.col("best_centroid").isNull()
    part = lambda i: F.when(unknown, "Unknown").otherwise(F.get(parts, i))
    return found.select("id", part(F.lit(0)).alias("pred_class"), F.when(unknown, "Unknown").when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("").alias("pred_order"), part(F.size(parts) - 1).alias("pred_superfamily"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard_sim"), F.coalesce("best_centroid", F.lit(".")).alias("best_centroid"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """A TSV with similarities of four decimals, rounded as C does: by the double's exact value, halves to even."""
    predictions.select(*[F.expr(f"format_number({c}, '0.0000')").alias(c) if c == "jaccard_sim" else F.col(c) for c in PREDICTIONS]).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")
