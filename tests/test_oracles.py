"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tests.oracle_check import compare, connect, table_of

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(name, spark, duck):
    got = contract.queries()[name](spark, SMALL).toArrow()
    if name in ORACLES:
        assert compare(name, got, table_of(duck, ORACLES[name])) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())
