"""Every query with SQL gives what DuckDB gives on the same tables; the others give rows of a stable schema."""

import math

import duckdb
import pytest
from strandlake.plans import catalog, planted
from strandlake.plans.registry import Tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE_SQL[name], duck)


@pytest.mark.parametrize("name", sorted(planted.PLANTED))
def test_planted(spark, sf, duck, name):
    """What was planted in generated genomes is found."""
    function, sql = planted.PLANTED[name]
    same(function(Tables(spark, sf)), sql, duck)


def same(found, sql, duck):
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in found.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"mem_chain_calls"}))
def test_rows_only(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query", "reference", "shared", "jaccard", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
