"""Every query with SQL against DuckDB on the small tables; every other one has rows."""

import os

import duckdb
import pytest

from quillspark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rounded(x):
    return round(x, 9) if isinstance(x, float) else x


def ordered(names, rows):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(rounded(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        wanted = duck.sql(SQL[name])
        assert ordered(df.columns, rows) == ordered(wanted.columns, wanted.fetchall())
    else:
        assert rows


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() == 20
