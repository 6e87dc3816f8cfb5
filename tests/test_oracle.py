"""Every query with an SQL twin gives the same rows."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, sf, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], sf) is None


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["platform", "risk_category", "messages"]
    assert out.count() > 0
