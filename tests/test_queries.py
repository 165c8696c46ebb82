"""Queries against their SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from lexspan.plans import analytics, exchange, product, profile  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [*analytics.QUERIES, *product.QUERIES]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(r) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    both = analytics.QUERIES | product.QUERIES
    sql = analytics.SQL | product.SQL
    assert rows(both[name](spark, SF).toPandas()) == rows(con.sql(sql[name]).df())
