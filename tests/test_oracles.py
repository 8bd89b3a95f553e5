"""Every registered query against its oracle."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, con, name):
    told = check.compare(spark, con, SF, name)
    assert told.startswith("ok"), told


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(entry.QUERIES) <= set(entry.oracle_sql())
