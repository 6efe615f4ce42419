"""What workers keep in memory between blocks and tasks."""

import numpy as np
import pyarrow as pa
from strandlake.llm import decontam, text


def test_powers_are_not_twice_as_many(monkeypatch):
    monkeypatch.setattr(text, "_cache", {})
    up, down = text.powers((4 << 20) + 1)
    assert len(up) == len(down) == 5 << 20 and up[-1] * down[-1] == np.uint64(1)


def test_rows_of_the_index_are_small(spark):
    docs = spark.createDataFrame([(i, "word " * 100_000) for i in range(12)], "doc_id long, text string").coalesce(1)
    assert decontam.build_index(docs).count() == 3


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    ended = []
    monkeypatch.setattr(text, "_trim", lambda: ended.append(1))
    batch = pa.record_batch({"x": [1]})
    rows = text.released(iter([batch, batch]))
    assert next(rows) is batch and not ended
    assert list(rows) == [batch] and ended == [1]
