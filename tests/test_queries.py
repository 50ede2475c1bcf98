"""Every registered query gives the rows of its SQL."""

from __future__ import annotations

import pytest
from conftest import SF, same_rows

from provlog.plans import operations, queries, verification  # noqa: F401
from provlog.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
