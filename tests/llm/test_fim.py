"""Fill in the middle: the bit vectors, and the transformation against its definition."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.llm import fim
from strandlake.session import table

from tests.llm import brute

DOCS = [
    (1, "one\ntwo\nthree\n"), (2, "one\ntwo\nthree"), (2, "one\ntwo\nthree"), (3, ""), (4, None), (None, "a\nb\nc"), (None, None), (5, "\n"), (6, "\n\n\n"), (7, "no line feed"), (8, "x<P>y\nz\n"), (9, "x\n<M>"), (10, "<S>"),
    (11, "<\nP\n>\n<P\nS>\n<"), (12, "é\n漢字\n🙂🙂\n\rß\x0b\x85\u2028end"), (13, "line of text\n" * 5000), (14, "x" * 3000), (15, "\x00\n\x00"), (16, "<S\n<M\n<P\n" * 4), (-17, "minus\nid\n"),
]
SCHEMA = "doc_id long, text string, n long, form string, output string, h0 int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, "f", "o", 2) for d, t in DOCS], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
def test_rank_and_select(n):
    for share in (0.0, 0.02, 0.5, 1.0):
        mask = np.random.default_rng(n).random(n) < share
        bits, sums = fim.Bits(mask), np.concatenate([[0], np.cumsum(mask)])
        assert (bits.rank(np.arange(n + 1)) == sums).all()
        assert not mask.any() or (bits.select(np.arange(1, mask.sum() + 1)) == np.flatnonzero(mask)).all()


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 60, "spm_rate": 20}, {"rate": 0}, {"spm_rate": 100}])
def test_transformation(docs, options):
    rows = fim.transform(docs, **options)
    assert Counter(map(tuple, rows.collect())) == Counter(brute.fim(d, t, **options) for d, t in DOCS)
    back = rows.select("doc_id", fim.restored(F.col("output"), F.col("form")))
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t in DOCS)


def test_blocks_do_not_matter(docs, monkeypatch):
    expected = Counter(map(tuple, fim.digests(docs).collect()))
    monkeypatch.setattr(fim.blocks, "__defaults__", ("text", 7))
    assert Counter(map(tuple, fim.digests(docs.coalesce(1)).collect())) == expected


def test_whole_table(spark, sf):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = table(spark, sf, "documents")
    expected = Counter()
    for r in docs.collect():
        *head, output = brute.fim(r["doc_id"], r["text"])
        expected[(*head, sha(output), sha(r["text"] or ""))] += 1
    assert Counter(map(tuple, fim.digests(docs).collect())) == expected
    assert fim.digests(docs.limit(0)).count() == 0
