"""Streams whose state belongs to keys: sketches that grow, and contigs that are given out when they have fallen silent.

Spark keeps the state of each key in its state store, so a micro-batch reads and writes the keys that it touches, and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandlake.session import scratch_path
from strandlake.streaming.incremental import _epochs, file_stream  # noqa: F401  streams of tables begin there

#: Fixed value: the state store that such streams need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Smallest(StatefulProcessor):
    """Keeps the n smallest distinct values of a key, and gives out the list whenever it changes."""

    def __init__(self, n: int, kind: str):
        self.n, self.kind = n, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("smallest", f"values array<{self.kind}>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        before = list(self.held.get()[0]) if self.held.exists() else []
        best = set(before)
        for row in rows:
            if row["value"] is not None:
                best.add(row["value"])
            if len(best) > 64 * self.n:  # never more than a few times the sketch
                best = set(sorted(best)[: self.n])
        now = sorted(best)[: self.n]
        if now != before:
            self.held.update((now,))
            yield Row(key=key[0], part=key[1], values=now)

    def close(self) -> None:
        pass


def smallest(rows: DataFrame, key: str, value: str, n: int, parts: int = 8) -> DataFrame:
    """(key, part, values): of a stream, the n smallest distinct values of each part of a key as state; it comes again with each change.

    Each batch of rows gives its own n smallest ones of a key, so most never meet the state. Values are dealt to the ``parts`` of a key by their hash, so that a key which has most rows isn't one task's; ``sketches`` brings them together.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.dropna(subset=["value"]).drop_duplicates().sort_values("value").groupby("key", dropna=False).head(n)

    own = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInPandas(least, f"key {kinds[key]}, value {kinds[value]}")
    dealt = own.select("key", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int").alias("part"), "value")
    return dealt.groupBy("key", "part").transformWithState(Smallest(n, kinds[value]), f"key {kinds[key]}, part int, values array<{kinds[value]}>", "Update", "None")


def sketches(found: DataFrame, n: int, name: str, path: str | None = None) -> DataFrame:
    """(key, values): the n smallest values of each key after all that is there now."""
    rows = latest(found, ["key", "part"], name, path)
    return rows.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("values"))), 1, n).alias("values"))


def latest(found: DataFrame, keys: list[str], name: str, path: str | None = None) -> DataFrame:
    """Runs a stream in update mode over all that is there now; of each key, the row of the last batch that had it. With the ``path`` of an earlier run it goes on from there."""
    spark = found.sparkSession
    path = path or scratch_path(spark, name)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    job = found.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(put).start()
    job.awaitTermination()
    epochs = _epochs(spark, path)
    if not epochs:
        return spark.createDataFrame([], found.schema)
    names = found.columns
    rows = spark.read.schema(found.schema).option("basePath", path).parquet(*[f"{path}/epoch={e}" for e in epochs])
    epoch = F.regexp_extract(F.col("_metadata.file_path"), r"epoch=(\d+)", 1).cast("long")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), epoch).alias("_row")).select("_row.*")


def silent(rows: DataFrame, contig: str, ts: str, gap: str, late: str) -> DataFrame:
    """The rows of each contig once it has been silent for ``gap``, with the first and the end of their session.

    ``late`` is how far behind the newest row others may still come; later ones are dropped. A contig that speaks again has another session.
    """
    columns = [c for c in rows.columns if c != contig]
    sessions = rows.withWatermark(ts, late).groupBy(contig, F.session_window(ts, gap).alias("w")).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    return sessions.select(contig, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), F.inline("_rows"))
