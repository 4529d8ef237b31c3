"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entries
from compare import connect, difference

SAMPLE = "/root/testdata/sf0.001"
#: Each compares rows that are there: no query of these gives none.
NAMES = """pattern_repeated_var not_bound_anti not_exists_anti minus_patterns minus_shared optional_chained_maybe_unbound values_join bind_extend dataset_from dataset_from_named
group_sum_avg theta_join uri_split calendar_accessors change_counts layouts_after_changes remove_quads ids_add trig_round_trip string_functions number_functions""".split()


@pytest.fixture(scope="module")
def tables():
    return connect(SAMPLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql(spark, tables, name):
    sql = entries.oracle_sql()[name]
    assert tables.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0
    assert difference(entries.queries()[name](spark, SAMPLE), tables, sql) == ""


def test_names_of_queries_and_sql_agree():
    assert set(entries.oracle_sql()) <= set(entries.queries())
