"""Streams with keyed state: sketches that grow over several runs, and contigs that are given out when they are silent."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from strandlake.session import scratch_path
from strandlake.streaming import incremental, state


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sketches_grow_with_the_keys_that_are_touched(spark, tmp_path, kind):
    r, folder, path = random.Random(1), str(tmp_path / "in"), scratch_path(spark, "grown")
    schema, n, seen = f"k string, h {kind}", 5, defaultdict(set)
    value = (lambda x: x) if kind == "long" else (lambda x: f"{x:06}")
    touched = []
    for batch in range(3):
        keys = ["a", "b", "c", None] if batch != 1 else ["b"]  # only one key in the second batch
        rows = [(r.choice(keys), value(r.randint(0, 3000))) for _ in range(400)] + [("b", None)]
        put(spark, folder, f"batch-{batch}", rows, schema)
        for k, h in rows:
            if h is not None:
                seen[k].add(h)
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        found = state.sketches(state.smallest(stream, "k", "h", n, 3), n, "grown", path)
        assert {x["key"]: x["values"] for x in found.collect()} == {k: sorted(v)[:n] for k, v in seen.items()}
        touched.append({x["key"] for x in spark.read.parquet(f"{path}/epoch={max(incremental._epochs(spark, path))}").collect()})
    assert touched[1] <= {"b"}  # keys without new rows are not written again


def test_contigs_are_given_out_when_they_are_silent(spark, tmp_path):
    folder, path, schema = str(tmp_path / "in"), scratch_path(spark, "silent"), "contig string, at long, call string"

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*").select("contig", F.timestamp_seconds("at").alias("ts"), "call")
        out = incremental.finished(state.silent(stream, "contig", "ts", "10 seconds", "5 seconds"), "silent", "append", path)
        return sorted((x["contig"], x["call"], x["session_start"].timestamp(), x["session_end"].timestamp()) for x in out.collect())

    put(spark, folder, "one", [("c1", 1000, "a"), ("c1", 1004, "b"), ("c2", 1012, "c")], schema)
    assert run() == []  # the watermark stands at 1007, the session of c1 ends at 1014
    put(spark, folder, "two", [("c2", 1018, "d"), ("c1", 1020, "e"), ("c3", 1021, "f")], schema)
    first = [("c1", "a", 1000, 1014), ("c1", "b", 1000, 1014)]
    assert run() == first  # 1016; what c1 says later is another session
    put(spark, folder, "three", [("c1", 1003, "too late"), ("c9", 1090, "g")], schema)
    assert run() == sorted([*first, ("c2", "c", 1012, 1028), ("c2", "d", 1012, 1028), ("c1", "e", 1020, 1030), ("c3", "f", 1021, 1031)])
    assert run() == run()
