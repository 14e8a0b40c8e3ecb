"""Every registered query against its SQL counterpart on the small tables."""

import os

import pytest

import __spark_entry__ as driver
from tests.oracle import connect, differences
from weirlog.plans.oracles import ORACLES
from weirlog.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(driver.queries()[name](spark, SF), con, driver.oracle_sql()[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
