"""The pipeline's decisions against brute force, stage by stage on each stage's own input."""

import corpus_pipeline
from strandlake.session import staged, table

from tests.llm import brute


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), name)
        assert docs.columns == columns
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "language_id":
            assert {d for d, _ in before} - {d for d, _ in after} <= {d for d, t in before if not any(c.isalpha() for c in t or "")}
        elif name == "near_duplicates":
            assert sorted(d for d, _ in after) == sorted(brute.kept_first(before))
        elif name == "decontamination":
            assert sorted(d for d, _ in after) == sorted(d for d, *_, c in brute.contamination(before, items) if not c)
        else:
            texts = dict(before)
            assert sorted(d for d, _ in after) == sorted(texts)
            for d, t in after:
                spans = brute.secrets(texts[d])[2]
                assert ("[SECRET]" in t) >= bool(spans) and (spans or t == texts[d] or "[SECRET]" in t)
        before = after
    assert docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
