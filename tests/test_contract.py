"""The driver's contract: every query runs, and agrees with its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from edgesmith.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")


def _values(pdf):
    cols = sorted(pdf.columns)
    out = []
    for row in pdf[cols].itertuples(index=False):
        out.append(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row))
    return cols, sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert _values(catalogue.QUERIES[name](spark, SF).toPandas()) == _values(con.sql(catalogue.SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
