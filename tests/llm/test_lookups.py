"""Look-ups in models of many files: what is opened and visited, and what is found."""

import os

import numpy as np
import pyarrow as pa
import pytest
from strandlake.llm import arrays, kneser_ney


def test_files_of_many_shards_stay_mapped(tmp_path):
    """5,000 files that are read in turn, as each run of look-ups does, are opened once; none stays open."""
    for k in range(5000):
        arrays.save(str(tmp_path), f"a{k}", np.arange(2) + k)
    before, arrays_of = arrays._opened.cache_info().misses, lambda: [int(arrays.mapped(str(tmp_path), f"a{k}", 2)[1]) for k in range(5000)]
    open_files = len(os.listdir("/proc/self/fd"))
    assert arrays_of() == arrays_of() == list(range(1, 5001))
    assert arrays._opened.cache_info().misses - before == 5000 and len(os.listdir("/proc/self/fd")) < open_files + 100


@pytest.mark.parametrize("array", [np.arange(6).reshape(2, 3), np.asfortranarray(np.arange(6.0).reshape(2, 3)), np.zeros((0, 5), np.uint64), np.arange(12, dtype=np.uint8).reshape(3, 4)[:, :3]])
def test_mapped_arrays_are_those_saved(tmp_path, array):
    arrays.save(str(tmp_path), "one", array)
    found = arrays._opened(str(tmp_path), "one")
    assert found.dtype == array.dtype and found.shape == array.shape and np.array_equal(found, array) and not found.flags.writeable


def test_batches_are_looked_up_together(spark, monkeypatch):
    """Texts of many batches visit each shard once, and are scored as each by itself."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 40, n)) for n in r.integers(0, 30, 200)] + [None, ""]
    monkeypatch.setattr(kneser_ney, "SHARD_KEYS", 100)
    model = kneser_ney.train(spark.createDataFrame(list(enumerate(texts[::2])), "doc_id long, text string"))
    assert len(model.edges) > 8
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    visits, mapped = [], kneser_ney.mapped
    monkeypatch.setattr(kneser_ney, "mapped", lambda folder, name, size: (visits.append(name), mapped(folder, name, size))[1])

    def scores():
        ids, out = [], []
        for rows, hashes, first in kneser_ney.gathered(iter(batches)):
            distinct, rank = np.unique(hashes, return_inverse=True)
            out += np.add.reduceat(model.log_probability(model.vocabulary.find(distinct)[0], rank, first), first[:-1]).tolist()
            ids += [i for b in rows for i in b.column("doc_id").to_pylist()]
        return ids, out

    ids, together = scores()
    # times-whole is read beside times, and a file may be asked for by several steps of one run
    assert ids == list(range(len(texts))) and max(map(visits.count, set(visits))) <= 2
    monkeypatch.setattr(kneser_ney, "TOKENS", 1)
    assert scores() == (ids, pytest.approx(together, abs=1e-9))
