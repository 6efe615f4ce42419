"""Arrays in shared storage, and the index family that lives there."""

import random
from collections import Counter

import numpy as np
import pytest
from strandlake.llm import arrays, simhash_vp, suffix_levels

from tests.llm import brute

LINE = "a line that very many documents share, each in surroundings of its own"


def texts(seed, n):
    r, out = random.Random(seed), []
    for _ in range(n):
        own = "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 160)))
        if out and r.random() < 0.4:
            own += r.choice(out)[: r.randint(0, 120)]
        out.append(own + (LINE + own[:20] if r.random() < 0.5 else ""))
    return out


def test_a_missing_array_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        arrays.mapped(str(tmp_path), "none", 3)
    arrays.save(str(tmp_path), "some", np.arange(3))
    assert arrays.mapped(str(tmp_path), "some", 3).tolist() == [0, 1, 2] and not len(arrays.mapped(str(tmp_path), "none", 0))
    with pytest.raises(RuntimeError):
        arrays.mapped(str(tmp_path), "some", 4)


def test_arrays_without_a_mount(tmp_path):
    folder = f"file://{tmp_path}"  # an address, as of an object store
    arrays.save(folder, "one", np.arange(5))
    assert arrays.mapped(folder, "one", 5).tolist() == list(range(5))


def test_arrays_that_are_kept_have_a_bound(tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "KEPT_BYTES", 100 * 8)
    monkeypatch.setattr(arrays, "_kept", {})
    folder = f"file://{tmp_path}"
    for k in range(8):
        arrays.save(folder, f"a{k}", np.arange(40) + k)
    for k in (0, 1, 0, 2, 0, 3):
        assert arrays._fetched(folder, f"a{k}")[0] == k
    assert [n for _, n in arrays._kept] == ["a0", "a3"]  # the last ones that fit
    arrays.save(folder, "big", np.arange(1000))
    assert len(arrays._fetched(folder, "big")) == 1000 and [n for _, n in arrays._kept] == ["big"]


def test_packed_keys():
    keys, counts = np.array([1, 5, 2**63, 2**64 - 1], np.uint64), np.array([9, 1, 2**40, 3], np.uint64)
    assert all(np.array_equal(a, b) for a, b in zip(arrays.unpack(arrays.pack(keys, counts, counts), 3), (keys, counts, counts)))


def test_hot_strings(spark):
    docs = list(enumerate(texts(3, 120)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    expected = Counter(brute.substrings(docs))
    folder = arrays.new_folder(spark, "grams")
    assert suffix_levels.repeated_grams(frame, folder, 4, 3).sizes[:, 1].sum() > 3
    for hot in (1, 3, 1000):
        assert Counter(map(tuple, suffix_levels.dedup(frame, hot=hot).collect())) == expected


def test_batches_meet_in_the_family(spark, monkeypatch):
    monkeypatch.setattr(suffix_levels, "BATCH", 256)
    docs = list(enumerate(texts(4, 150)))
    expected = Counter(brute.substrings(docs))
    family, found = suffix_levels.Family.new(spark, 3), Counter()
    for low, high in ((0, 60), (60, 110), (110, 150)):
        batch = spark.createDataFrame(docs[low:high], "doc_id long, text string")
        found.update(map(tuple, family.add(batch).collect()))
    assert found == expected
    assert family.version == 3 and all(1 < len(s) for s in family.state.values())


def test_ids_that_are_strings(spark):
    docs = [(f"d{i:03}", t) for i, t in enumerate(texts(5, 40))]
    frame = spark.createDataFrame([*docs, (None, LINE * 2)], "doc_id string, text string")
    found = {r["doc_id"]: tuple(r) for r in suffix_levels.dedup(frame).collect()}
    assert [found[d] for d, _ in docs] == brute.substrings(docs) and found[None][2] == 0


def test_overfull_leaves_are_cut_again():
    r = random.Random(4)
    marks = {r.getrandbits(64) for _ in range(4000)}
    for m in list(marks)[:1500]:
        marks.add(m ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    every = np.array(sorted(marks), np.uint64)
    up = {int(m): int(m) for m in every}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sizes = []
    whole = simhash_vp.forest
    simhash_vp.forest = lambda stored, asking, radius: sizes.append(len(stored)) or whole(stored, asking, radius)
    try:
        for shift in (0, 32):
            for a, b in simhash_vp.shard_links(every, every, 3, shift, 32, 1, 32):
                for x, y in zip(a.tolist(), b.tolist()):
                    up[find(x)] = find(y)
    finally:
        simhash_vp.forest = whole
    a, b = whole(every, every, 3)
    exact = len(every) - len(set(a.tolist()))
    assert len({find(int(m)) for m in every}) == exact and max(sizes) <= 4 * 32


def test_each_shard_has_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 130).select((F.col("id") % 13).cast("int").alias("shard"))
    placed = arrays.dealt(rows, 13).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(placed) == 13 and len({r["p"] for r in placed}) == 13
