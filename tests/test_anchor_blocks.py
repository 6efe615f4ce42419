"""Blocks of sets, which cells of pairs read: shuffled once, however many there are, and never short."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from strandlake.operators import sketch
from strandlake.session import staged

from tests.measured import shuffled


def test_sets_are_shuffled_once_however_many_blocks(spark, monkeypatch):
    """300 sets of 100 of 1,000 anchors, in a few blocks and in thirty: with thirty a set meets the others in thirty cells."""
    rows = spark.range(300).selectExpr("id AS read", "explode(transform(sequence(0, 99), i -> md5(cast(pmod(xxhash64(id, i), 1000) AS string)))) AS h")
    classes = staged(sketch.anchor_classes(rows, "read"), "classes")
    totals, found = [], []
    for most in (3_000_000, 1_000):
        monkeypatch.setattr(sketch, "CELL_POSTINGS", most)
        with shuffled(spark) as total:
            found.append(sorted(map(tuple, sketch.exact_anchor_pairs(classes, "read").collect())))
        totals += total
    assert found[0] == found[1] and len(found[0]) > 44_000
    assert 0 < totals[1] < 2 * totals[0]


def test_a_block_that_lacks_sets_is_an_error(tmp_path):
    (tmp_path / "block=3").mkdir()
    sets = pa.table({"_id": ["x", "y"], "_members": [1, 2], "_anchors": pa.array([[5, 7], [7]], pa.list_(pa.int64()))})
    pq.write_table(sets, tmp_path / "block=3" / "part-0.parquet")
    ids, members, anchors, rows = sketch._block(f"file:{tmp_path}", 3, 2)
    assert (ids.to_pylist(), members.tolist(), anchors.tolist(), rows.tolist()) == (["x", "y"], [1, 2], [5, 7, 7], [0, 0, 1])
    with pytest.raises(RuntimeError, match="2 sets of block 3 in place of 4"):
        sketch._block(str(tmp_path), 3, 4)
    with pytest.raises(FileNotFoundError):
        sketch._block(str(tmp_path), 4, 1)
