"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle_compare import connect, difference

import __spark_entry__ as entry
from tallyline.plans.catalog import QUERIES
from tallyline.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_twin(spark, con, name):
    found = difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert found is None, found


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry_registers_the_catalog():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
