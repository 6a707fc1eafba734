"""Registered queries vs their DuckDB twins at sf0.01 (a representative subset;
``python tests/oracle.py`` runs the whole catalogue)."""

import pytest

from conftest import SF001
from oracle import compare, duck

SUBSET = [
    "min_slice", "dedupe_last", "pitcher_features", "batter_features", "spray_rates", "first_pitch_strike",
    "velo_split", "pitch_type_shares_wide", "batter_rows_enriched", "fielding_metrics", "union_positions",
    "corr_pairs", "nzv_stats", "knn_euclidean", "knn_cohort", "silhouette_euclidean", "davies_bouldin",
    "cluster_profiles", "standardize_population", "clusters_payload", "search_names", "leaderboard",
    "landing_status_rollup", "ytd_window_scan", "event_type_entropy",
    "bronze_keep_last", "register_last_wins", "bronze_union_drift", "pitcher_features_minimal", "batter_features_minimal",
    "gmm_fixed_labels", "gmm_fixed_scores", "kmeans_fixed_labels", "project_fixed_model", "pca_invariants",
    "corr_prune_decisions", "gold_artifacts", "leaderboard_years", "framing_named",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, SF001, con)
    assert ok, msg


def test_catalogue_consistency():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
    assert set(SUBSET) <= set(o)


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns[:3] == ["pitcher", "year", "n_pitches_total"]
    assert all(r["n_pitches_total"] >= 60 for r in rows)
