"""The annotation of whole documents, against the kernels over sequences and means that plain Python makes of the table."""

import statistics

import pyarrow.parquet as pq
import pytest
from strandlake.operators import detectors
from strandlake.plans import catalog


def projected(text):
    return "".join("ACGT"[(ord(c) - 65) % 4] for c in text if c.isascii() and c.isalpha() for c in c.upper())


def test_element_annotation_of_every_document(spark, sf):
    docs = {r["doc_id"]: (r["lang"], projected(r["text"])) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist() if r["lang"] is not None and r["text"] is not None}
    mean = {c: statistics.fmean(detectors.gc(s) for lang, s in docs.values() if lang == c) for c in {lang for lang, _ in docs.values()}}
    found = {r["doc_id"]: r for r in catalog.QUERIES["element_annotation"](spark, sf).collect() if r["doc_id"] in docs}
    assert set(found) == set(docs)
    for doc, (lang, seq) in docs.items():
        start, end = detectors.boundary(seq, mean[lang])
        present, family, _, _, length, score = detectors.captain(seq)
        r = found[doc]
        assert (r["lang"], r["element"], r["bound_start"], r["bound_end"]) == (lang, detectors.element_class(seq, mean[lang]), start, end)
        assert (r["captain"], r["family"], r["orf_length"], r["captain_score"]) == (present, family, length, pytest.approx(score))
