"""Every registered query with a SQL twin equals it; the others give rows."""

import pytest

import __spark_entry__ as contract
from compare import database, difference

TWINS = sorted(contract.oracle_sql())
LIGHT = ["i4_full_report", "p10_seeded_sample"]


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", TWINS + LIGHT)
def test_query(spark, sf, con, name):
    assert difference(spark, con, sf, name) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["asset_id", "parameter", "n"]
    assert df.count() > 0


def test_twins_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
