"""Queries with SQL, against that SQL on the smallest tables."""

import pytest

from quire.llm import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert_same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


def test_ten_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
