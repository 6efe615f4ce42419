"""The chained calls reach references that share little of a query, or hold it as a small part."""

import random

from strandlake.plans import catalog


def test_distant_and_containing_references(spark, tmp_path):
    r = random.Random(1)
    base = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    own = base(1500)
    deleted = own[:700] + own[760:]
    texts = [own, base(9000) + deleted + base(9000), base(1500)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = {x["reference"] for x in catalog.QUERIES["mem_chain_calls"](spark, str(tmp_path)).collect()}
    assert found == {1}
