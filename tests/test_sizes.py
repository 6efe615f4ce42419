"""What only larger tables show: tables that are folders of files, and similarities that lie half-way."""

import math
import tracemalloc

import duckdb
import numpy as np
from pyspark.sql import functions as F
from strandlake.functions import sequence, stats
from strandlake.operators import elements, intervals
from strandlake.plans import catalog

from tests.test_catalog import same


def test_a_stream_of_a_folder(spark, sf, tmp_path):
    """A table that is a folder of parts comes whole."""
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    duck = duckdb.connect()
    for name in ("documents", "events"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("sketch_in_state", "contigs_fallen_silent"):
        same(catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLE_SQL[name], duck)


def test_similarities_are_rounded_as_by_c(spark, tmp_path):
    values = [1 / 32, 3 / 32, 0.0, 1.0, 1 / 3, 0.12345, 0.00125]
    rows = spark.createDataFrame([(str(i), "a", "", "b", x, "a/b") for i, x in enumerate(values)], "id string, pred_class string, pred_order string, pred_superfamily string, jaccard_sim double, best_centroid string")
    elements.write_predictions(rows, f"{tmp_path}/p")
    found = spark.read.csv(f"{tmp_path}/p", sep="\t", header=True)
    assert {r["id"]: r["jaccard_sim"] for r in found.collect()} == {str(i): f"{x:.4f}" for i, x in enumerate(values)}


def test_nearest_is_scanned_in_linear_time(spark):
    """A frame that ends with the last row is summed up anew for each row; intervals that begin at one place are one."""
    rows = spark.range(40_000).selectExpr("'k' AS k", "id % 20000 AS p", "3 * (id % 7000) AS s", "3 * (id % 7000) + id % 2 AS e", "id AS n")
    found = intervals.nearest(rows.select("k", "p"), rows.select("k", "s", "e", "n"), "k", "p", "s", "e", "n")
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    far = {r["p"]: r["distance"] for r in found.collect()}
    assert far == {p: 0 if p % 6 in (0, 3, 4) else 1 for p in range(20_000)}


def test_exact_tests_hold_no_more_for_larger_counts():
    """Of a law over millions only what lies around its mode is not zero; factorials of any size come from a table of bounded length."""
    a, b, c, d = 2_501_000, 7_500_000, 2_500_000, 7_499_000
    row, column, n = a + b, a + c, a + b + c + d
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    exact = sum(math.exp(choose(row, x) + choose(n - row, column - x) - choose(n, column)) for x in range(a, a + 60_000))
    tail = sum(math.exp(choose(n, x) + x * math.log(0.25) + (n - x) * math.log(0.75)) for x in range(5_002_000, 5_060_000))
    tracemalloc.start()
    found = stats.fisher_right_values(*(np.array([x]) for x in (a, b, c, d)))
    found2 = stats.binomial_tail_values(np.array([5_002_000]), np.array([n]), np.array([0.25]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert math.isclose(found[0], exact, rel_tol=1e-4) and 0.05 < exact < 0.95
    assert math.isclose(found2[0], tail, rel_tol=1e-4) and 0.01 < tail < 0.95
    assert peak < 64 << 20


def test_codons_are_counted_without_a_lambda(spark):
    """Stops of the first frame only, the last part codon left out, and no expression that is worked off codon by codon."""
    seqs = ["", "TA", "TAA", "ATAATG", "TAATAGTGATA", "TTAATAAA", "ATGATGTAAATGTA" * 50, "TGATTGATGA"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    found = rows.select("i", sequence.codon_count(F.col("s"), "TAA", "TAG", "TGA").alias("n"), sequence.codon_count(F.col("s"), "ATG").alias("m"))
    assert "lambda" not in found._jdf.queryExecution().toString()
    cut = [[s[i : i + 3] for i in range(0, len(s) - 2, 3)] for s in seqs]
    assert {r["i"]: (r["n"], r["m"]) for r in found.collect()} == {i: (sum(x in ("TAA", "TAG", "TGA") for x in c), c.count("ATG")) for i, c in enumerate(cut)}
