"""Phrase collocations: counts from suffix arrays, and the ranked phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from strandlake.llm import collocations
from strandlake.session import table

from tests.llm import brute


@pytest.mark.parametrize("words", [(1, 5), (2, 2), (3, 5), (1, 1)])
def test_counts_of_a_shard(words):
    r = np.random.default_rng(sum(words))
    for _ in range(60):
        ids = np.append(r.integers(0, r.integers(2, 9), r.integers(0, 80)), 0)
        expected = Counter(run[i : i + n] for run in re.findall("[1-9]+", "".join(map(str, ids))) for n in range(words[0], words[1] + 1) for i in range(len(run) - n + 1))
        found = Counter()
        for a, b, c, n in zip(*(x.tolist() for x in collocations.gram_counts(ids, *words)), strict=True):
            found["".join(str(x) for x in (a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF, c) if x)] += n
        assert found == expected


def test_suffixes_are_in_order():
    r = np.random.default_rng(1)
    ids = np.append(r.integers(0, 5, 400), 0)
    order, common = collocations.suffix_array(ids, 5)
    text = "".join(map(str, ids))
    suffix = [text[i:].split("0")[0][:5] for i in order.tolist()]
    assert suffix == sorted(suffix) and sorted(order.tolist()) == np.flatnonzero(ids).tolist()
    assert common.tolist()[1:] == [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(suffix, suffix[1:])]


def corpus(seed):
    r, vocabulary, out = random.Random(seed), ["the", "of", "La", "Ünï", "x\x00y", "état", "a-b", "ß", "漢字", "w1", "w2"], []
    lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 9))) for _ in range(12)]
    for i in range(120):
        parts = [r.choice(lines) if r.random() < 0.6 else " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 8))]
        out.append((i % 90, r.choice([". ", ", ", "\n", "\t ", "  ", "!?", "\x0b"]).join(parts), r.choice(["en", "en", "en", "fr", None, "und", ""])))
    return [*out, (None, None, "en"), (1, "", "fr"), (2, "only", "one"), *[(3, "same same same same same same same", "en")] * 30, (4, "the of " * 4000, "en")]


@pytest.mark.parametrize("least,top,share", [(3, 2000, 100), (10, 25, 60), (1, 50, 100), (100, 5, 100)])
def test_phrases(spark, least, top, share, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 700)  # several shards a task
    monkeypatch.setattr(collocations, "GATHERED", 400)
    rows = corpus(least)
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, lang string, a int, phrase string").repartition(3)
    found = sorted(map(tuple, collocations.collocations(frame, least, top, share).collect()))
    assert found == sorted(brute.collocations([r[1:] for r in rows], least, top, share))


def test_large_products_are_exact(spark):
    """Products beyond 64 bits, where doubles would round."""
    from pyspark.sql import functions as F

    a, n, l, r = 3_000_000_019, 9_000_000_000_000_037, 3_000_000_021, 4_000_000_007
    frame = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    text = "(cast(1000 AS decimal(38,0)) * cast(a AS decimal(38,0)) * cast(n AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))"
    assert frame.select(F.expr(text)).first()[0] == 1000 * a * n // (l * r)


def test_tables_without_phrases(spark, sf):
    docs = table(spark, sf, "documents")
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs, 20).collect())) == sorted(brute.collocations(rows, 20))
