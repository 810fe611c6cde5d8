"""Registered queries against the independent engine on the smallest tables.

One per operator family here, to keep the suite short; ``python tests/harness.py`` runs all.
"""

import pytest
from harness import compare, duck

import __spark_entry__ as entry


CORE = [
    "event_flags", "merge_outcome", "random_landmark", "measure_trend", "feature_table", "baseline_measures", "interval_build", "person_period",
    "permute_column", "standardize", "best_cutoff", "bootstrap_metric", "baseline_hazard", "c_index_ipcw", "km_by_stratum",
    "cox_fit", "permutation_importance_fixed", "density_curve", "variable_order", "pdp_common_grid", "strata_table", "profile_table", "partition_sink",
]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, sf, con, name):
    ok, message, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert ok, message


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and len(out.columns) > 40
