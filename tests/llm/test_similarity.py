"""The pipeline's near-duplicate stage against all pairs of exact Jaccard similarity, without any filter of candidates."""

import random

from pyspark.sql import functions as F
from strandlake.llm import jaccard

from tests.llm import brute


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def kept(spark, docs):
    return sorted(r["doc_id"] for r in jaccard.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_copies_at_the_threshold(spark):
    r, docs = random.Random(3), []
    for _ in range(60):
        own = words(r, r.randint(100, 600))
        long = own + words(r, (len(own) - 4) // 4 + r.randint(-3, 3))  # on both sides of 0.8
        edited = list(own)
        for at in r.sample(range(len(own)), len(own) // 50):
            edited[at] = "x"
        for one in (own, long, edited):
            docs.append((len(docs), " ".join(one)))
    assert kept(spark, docs) == sorted(brute.kept_first(docs))


def test_alike_is_exact():
    r = random.Random(5)
    texts = [" ".join(words(r, 200))]
    texts += [texts[0] + " " + " ".join(words(r, n)) for n in range(40, 60)] + ["a", "a b c d e f"]
    sets = [brute.shingles(t) for t in texts]
    found = jaccard.alike(jaccard.shingles(texts[0]), [jaccard.shingles(t) for t in texts])
    assert found.tolist() == [len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets] and 1 < found.sum() < 20


def test_equal_fingerprints_are_no_verdict(spark):
    r = random.Random(8)
    fillers = [" ".join(["0"] * 150 + words(r, 60)) for _ in range(4)]  # most bigrams are '0 0' in each
    assert len({brute.fingerprint(t, 2) for t in fillers}) == 1
    # a copy of a text that isn't the first of its fingerprint keeps its link
    texts = [*fillers, fillers[2] + " end", "a a", "a a a a a a", *(f"{'- ' * 40}{x}" for x in "xyz")]
    docs = list(enumerate(texts))
    assert kept(spark, docs) == sorted(brute.kept_first(docs))
    assert {0, 1, 2, 3, 5, 6} <= set(kept(spark, docs)) and 4 not in kept(spark, docs)


def test_null_and_repeated_ids(spark):
    r = random.Random(2)
    a, b, c, d, e = (" ".join(words(r, 50)) for _ in range(5))
    # null ids: a copy of 1 goes, the others stay; 2 twice with different texts; 3 with a copy of 1 and a text of its own; 4 twice the same
    docs = [(1, a), (None, a + " end"), (None, b), (None, c), (2, d), (2, e), (3, a), (3, "a text of its own"), (4, "same"), (4, "same"), (None, ""), (None, None)]
    found = [(x["doc_id"], x["text"] or "") for x in jaccard.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(1, a), (None, b), (None, c), (2, d), (2, e), (3, "a text of its own"), (4, "same"), (None, "")], key=str)


def test_large_bands(spark, monkeypatch):
    """The filters of large bands and the blocks of very large ones lose nothing."""
    r, docs = random.Random(12), []
    base = words(r, 150)
    for _ in range(150):
        own = list(base)
        for at in r.sample(range(150), r.choice([0, 1, 2, 3, 4, 6, 9])):
            own[at] = f"e{r.randrange(40)}"
        docs.append((len(docs), " ".join(own[r.randrange(3) : 150 - r.randrange(20)])))
    expected = sorted(brute.kept_first(docs))
    assert 10 < len(expected) < 140
    assert kept(spark, docs) == expected
    sets = [jaccard.shingles(t) for _, t in docs]
    joined = jaccard.Joined()
    links = jaccard.filtered(list(range(len(docs))), sets, joined, 0.8)
    assert len(links) == len(docs) - len({joined.find(i) for i in range(len(docs))}) == len(docs) - len(expected)
    assert [p for p in jaccard.blocked(0, 5)] == [[(0, 5)]]
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    met = {(a, b) for p in jaccard.blocked(0, 9) for s, e in p for a in range(s, e) for t, f in p for b in range(t, f)}
    assert met == {(a, b) for a in range(9) for b in range(9)}


def test_simhash_proposes_pairs(spark, monkeypatch):
    """Without any MinHash band the SimHash components alone bring near copies together; exact similarity decides."""
    r = random.Random(3)
    base, other = words(r, 3000), words(r, 3000)
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(["x", *base]), " ".join(other), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alone = lambda found: found.withColumn("bands", F.lit(None).cast("binary"))
    plain = jaccard.classes
    monkeypatch.setattr(jaccard, "classes", lambda d: alone(plain(d)))
    assert sorted(x["doc_id"] for x in jaccard.keep_first(docs).collect()) == [0, 3, 4]  # no words: one class
