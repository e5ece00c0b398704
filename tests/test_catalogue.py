"""Every query of the catalogue against its SQL."""

import pytest

from quire.operators import search
from quire.plans import catalogue
from quire.plans.proxy import Roles
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert_same(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_columns_and_filters_reach_the_scan(spark, sf):
    plan = catalogue.queries()["year_papers_both_venues"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_comment" not in plan
    supplier = search.text_search(Roles(spark, sf).authors.filter("author_id = 3"), "sup", "name")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s_suppkey,3)" in supplier and "s_acctbal" not in supplier
