"""Streaming forms: windowed counts, de-duplication and bounded top-k, with exactly-once sinks.

``events.ts`` has no time zone; streams cast it to a timestamp, for watermarks. Each stream checkpoints beside its sink, under a new folder of the
shared one or at a path that is given; a run with the path of an earlier one goes on where that stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.session import scratch_path, table

LATE = "10 minutes"


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    # by a pattern, since a path that is a plain file would have to be a folder
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream with event time."""
    return file_stream(spark, sf_dir, name).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def window_counts(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows."""
    found = events.groupBy(F.window("ts", size, slide or size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("event_type", "n", "total", F.col("w.start").alias("start"))


def best_per_key(events: DataFrame) -> DataFrame:
    """Repeated observations of one key: how many, and the first."""
    return events.groupBy("user_id", F.round("value", 2).alias("value_bin")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """First arrival of each key within the watermark; state is dropped behind it."""
    return events.dropDuplicatesWithinWatermark(keys)


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the micro-batches that are wholly written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    names = [s.getPath().getName() for s in store.listStatus(at) if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def finished(found: DataFrame, name: str, mode: str, path: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, and returns what its sink holds in the end.

    The sink writes each micro-batch under its number, so a replayed batch overwrites itself; in complete mode the last one is the state. With a ``path``
    of its own a later run goes on where this one stopped: progress is read from the stream's checkpoint and the sink, never from this process.
    """
    spark = found.sparkSession
    path = path or scratch_path(spark, name)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    job = found.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(put).start()
    job.awaitTermination()
    epochs = _epochs(spark, path)
    parts = [f"{path}/epoch={e}" for e in (epochs[-1:] if mode == "complete" else epochs)]
    return spark.read.schema(found.schema).parquet(*parts) if parts else spark.createDataFrame([], found.schema)


def bounded(source: DataFrame, keys: list[str], order: list, k: int, name: str, path: str | None = None) -> DataFrame:
    """The first k rows of each key over a stream: every micro-batch merges its own with the best so far, which it reads from the sink.

    That is also how a sketch of the k smallest hashes grows with its input. A batch that is replayed reads the state of the batch before it again.
    """
    spark = source.sparkSession
    path = path or scratch_path(spark, name)
    w = Window.partitionBy(*keys).orderBy(*order)

    def put(batch: DataFrame, epoch: int) -> None:
        before = [e for e in _epochs(batch.sparkSession, path) if e < epoch]
        rows = batch.sparkSession.read.schema(source.schema).parquet(f"{path}/epoch={before[-1]}").unionByName(batch) if before else batch
        rows.dropDuplicates().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    job = source.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(put).start()
    job.awaitTermination()
    epochs = _epochs(spark, path)
    return spark.read.schema(source.schema).parquet(f"{path}/epoch={epochs[-1]}") if epochs else spark.createDataFrame([], source.schema)


def top_k(spark: SparkSession, sf_dir: str, k: int, path: str | None = None) -> DataFrame:
    """The k largest values of each type."""
    source = stream(spark, sf_dir, "events").select("event_type", "value", "event_id")
    return bounded(source, ["event_type"], [F.col("value").desc(), F.col("event_id")], k, "topk", path)


def sketch_stream(hashes: DataFrame, key: str, n: int, path: str | None = None) -> DataFrame:
    """The n smallest hashes of each key (key, h) of a stream of hashes: the state of a sketch that is built up bit by bit."""
    return bounded(hashes.select(key, "h"), [key], [F.col("h")], n, "sketch", path)


def stop_after(job, seconds: float) -> bool:
    """Waits so long for a running query and then lets it end after its present batch; whether it had ended by itself. What it wrote stays, and a new start goes on from there."""
    if job.awaitTermination(seconds):
        return True
    job.stop()
    return False
