"""Registered queries against DuckDB on the smallest data: some of every family. tools/check.py runs them all."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
KEYS = ("flagship_success_by_graph", "agg8_inverse_ecdf_quantiles", "agg15_cost_grouping_sets", "agg17_warm_pool", "gr6_adjacency_moments",
        "ded2_wl_hash", "flt8_attempt_validation", "set1_union_reference_pools", "jn8_retry_join", "pln1_base_task_plan", "pln10_split_assignment",
        "ang9_align_label", "cmp6_rule_start_summary", "cmp14_reference_stability", "lrn5_random_folds", "src9_input_set_digest", "snk5_reference_set",
        "str2_incremental_selection")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, duck, key):
    text, _, good = compare(spark, duck, key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert good, text


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 15
