"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from caderneta.plans import catalog
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
catalog.load()
PLANS, SQL = catalog.PLANS, catalog.SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(PLANS))
def test_query(spark, con, name):
    ok, note, _ = check(spark, con, SF, name, PLANS[name], SQL.get(name))
    assert ok, note


def test_entry(spark):
    assert E.entry(spark).columns == ["method_used", "n", "pct"]


def test_entry_points_offer_the_catalog():
    assert set(PLANS) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql()) <= set(E.queries())
