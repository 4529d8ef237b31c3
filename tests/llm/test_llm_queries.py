"""Registered queries of this subpackage against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from compare import connect, difference
from quadlake.llm import queries

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SAMPLE)


@pytest.mark.parametrize("name", ["p2_bounds", "p2_found", "p4_bounds", "p4_joint_bounds", "p6_reopened", "p7_texts", "p9_found"])
def test_query_and_sql(spark, tables, name):
    assert difference(queries.QUERIES[name](spark, SAMPLE), tables, queries.SQL[name]) == ""


def test_joint_queries_plan_no_products(spark):
    for name in ("p4_graphs", "p4_days"):
        plan = queries.QUERIES[name](spark, SAMPLE)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
