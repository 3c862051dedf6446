"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check import duck, normal
from tidemark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(contract.oracle_sql()[name])
    assert got == normal([d[0] for d in cursor.description], cursor.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
