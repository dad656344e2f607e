"""Every registered query of the graph engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from netloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    spark.catalog.clearCache()
    if name not in catalogue.ORACLES:
        assert found
        return
    expected = con.sql(catalogue.ORACLES[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert found == sorted((tuple(norm(r[i]) for i in at) for r in expected.fetchall()), key=str)
