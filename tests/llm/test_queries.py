"""The corpus queries that SQL can express, against their SQL on the smallest tables."""

import pytest

from caderneta.llm import queries
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    ok, note, _ = check(spark, connect(SF), SF, name, queries.PLANS[name], queries.SQL[name])
    assert ok, note


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.PLANS if n != "pipeline") == list(range(1, 14))
