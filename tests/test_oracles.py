"""A spread of registered queries against their SQL; ``check_oracles.py`` runs them all."""

import pytest
from check_oracles import compare, duck

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CHOSEN = [
    "derive_strikes", "normalize_strikes", "sink_roundtrip", "airport_overview", "describe_duration", "hist_dist",
    "corr_matrix", "features_v4", "ctx_counts_probes", "gain_risk_curve", "gain_risk_by_airport", "best_theta",
    "curve_comparison", "unknown_alerts", "binary_metrics", "metrics_by_airport", "f1_grid_200", "oof_compare",
    "group_kfold", "minority_neighbours", "alert_sessions", "stream_sessions", "ctx_counts_range_join", "leak_guard",
    "scan_sample", "calibration_checks",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    verdict, n = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert verdict == "ok" and n > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
