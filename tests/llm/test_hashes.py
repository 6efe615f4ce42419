"""Hashes of words, shingles and spans: periodic spans on which sums modulo 2**64 agree."""

import numpy as np
from strandlake.llm import decontam, jaccard, kneser_ney, simhash_vp, text


def opposite_words(n=2048):
    """Two words of n letters that differ everywhere and have equal sums for any odd base."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_spans():
    for n in (8, 64, 1024, 4096):
        one, two = opposite_words(n)
        data = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
        starts = np.array([0, n + 1, 2 * n + 2])
        a, b, c = text.span_hash(text.prefix_hash(data), starts, starts + n)
        assert a == c and a != b


def test_operators(spark):
    one, two = opposite_words()
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([f"{one} x"] * 12 + [f"{two} x"] * 12)], "doc_id long, text string")
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    found = {r["doc_id"]: r["contaminated"] for r in decontam.contamination(docs, items).collect()}
    assert all(found[i] == (i < 12) for i in range(24))
    seen = spark.createDataFrame([(0, f"{one} x"), (1, f"{one} x")] + [(i, f"{two} x") for i in range(2, 60)], "doc_id long, text string")
    known = {r["doc_id"]: (r["held_out"], r["n_known"]) for r in kneser_ney.score(seen.filter("doc_id < 2").union(seen.filter("doc_id >= 2 AND crc32(cast(doc_id AS string)) % 7 = 2"))).collect()}
    assert known[0] == (False, 3) and all(known[i] == (True, 2) for i in known if i > 1) and len(known) > 3
    assert not np.intersect1d(jaccard.shingles(one), jaccard.shingles(two)).size
    assert len({r["fingerprint"] for r in simhash_vp.near_duplicates(docs).collect()}) == 2
