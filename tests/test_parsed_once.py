"""What several rules read is parsed, or derived, once."""

from __future__ import annotations

import pytest
from conftest import SF

from provlog.plans import queries, verification  # noqa: F401
from provlog.plans.registry import QUERIES


def plan_of(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["terms_declared", "call_pairs", "cross_graph_errors", "segment_reports", "signed_segments"])
def test_lines_are_parsed_once(spark, name):
    assert plan_of(spark, name).count("(?=\\x20|\\z)") <= 1  # the pattern of tokens


@pytest.mark.parametrize("name, passes", [("unreadable_lines", 1), ("run_by_kind", 2)])
def test_lines_and_what_stands_between_them_are_one_pass(spark, name, passes):
    assert plan_of(spark, name).count("Relation [") <= passes  # lines, and headers where they are asked for
