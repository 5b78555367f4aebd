"""Every registered query against its SQL on the smallest tables."""

import pytest
from helpers import SF

import __spark_entry__ as entry
from checks.run import check, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert check(spark, con, SF, name).startswith(("ok", "rows only"))


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
