"""All queries of the catalogue against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{DATA}/events.parquet'")
    return c


def test_each_query_has_sql():
    assert queries().keys() == oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    got = queries()[name](spark, DATA)
    want = db.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.select(*columns).fetchall())
