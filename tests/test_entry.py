"""Registered queries against their SQL at the smallest scale, as the driver compares them."""

import os

import pytest

import __spark_entry__ as entry
from tidemark import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.sql(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    a, b = (sorted(map(repr, registry.queries()[name](spark, DATA).collect())) for _ in range(2))
    assert a == b and a


def test_flagship(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_all_queries_are_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())
