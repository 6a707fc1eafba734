"""Gold preprocessing: fill, hard drop, correlation prune, near-zero variance, name rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import gold as gd


def _one(gold, config=gd.GoldConfig()):
    (key,) = gold.frames
    return gold.frames[key], gd.cohort_metadata(gold, key, config)


def test_fill_and_hard_drop(spark):
    rows = [(1, 2023, "batter", "A", 10.0, None, 1.5, 0.3, 0.31, 1.0),
            (2, 2023, "batter", "B", None, 1.9, None, 0.4, 0.29, 2.0),
            (3, 2023, "batter", None, 12.0, 2.0, 0.5, None, 0.35, 3.0),
            (4, 2023, "batter", "D", 11.0, 2.1, 0.7, 0.2, 0.33, float("inf"))]
    df = spark.createDataFrame(rows, "player_id long, year int, role string, player_name string, "
                                     "pt_FF_release_speed_mean double, def_pop_time_2b_sec double, def_framing_runs double, "
                                     "estimated_woba_using_speedangle_mean double, woba_value_mean double, extra double")
    frame, art = _one(gd.preprocess_cohorts(df, gd.GoldConfig(correlation_threshold=1.01, near_zero_variance_unique_ratio=0.0)))
    assert "woba_value_mean" in art["hard_dropped_columns"] and "woba_value_mean" not in frame.columns
    assert "pt_FF_release_speed_mean" in art["archetype_training_dropped_columns"]
    assert gd.missing_value_report(frame) == {}
    got = {r["player_id"]: r for r in frame.collect()}
    assert got[2]["def_framing_runs"] == 0.0 and got[4]["extra"] == 0.0  # inf -> NULL -> 0
    assert got[3]["player_name"] is None  # ids untouched
    assert "def_framing_runs" in art["numeric_columns_filled_zero"]


def test_name_rules_keep_unlisted_share(spark):
    rows = [(i, 2023, "pitcher", 0.3 + i / 100, 0.1 * i, 0.5 + (i % 3) / 10, 0.2 + i / 50, 0.3 - i / 70) for i in range(3)]
    df = spark.createDataFrame(rows, "player_id long, year int, role string, pitch_type_FF_share double, "
                                     "pitch_type_other_share double, pitch_type_entropy double, xwoba_allowed_lhb_mean double, "
                                     "platoon_xwoba_allowed_diff double")
    frame, art = _one(gd.preprocess_cohorts(df, gd.GoldConfig(correlation_threshold=1.01, near_zero_variance_unique_ratio=0.0)))
    assert "pitch_type_FF_share" not in frame.columns and "xwoba_allowed_lhb_mean" not in frame.columns
    assert "pitch_type_other_share" in frame.columns and "pitch_type_entropy" in frame.columns


def test_correlated_pair_keeps_preferred(spark):
    vals = [0.30, 0.35, 0.28, 0.41]
    rows = [(i, 2023, "batter", v, v, float(i * i)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "player_id long, year int, role string, estimated_woba_using_speedangle_mean double, "
                                     "actual_quality_mean double, other double")
    frame, art = _one(gd.preprocess_cohorts(df, gd.GoldConfig(near_zero_variance_unique_ratio=0.0)))
    assert art["dropped_columns"]["correlation_drop"] == ["actual_quality_mean"]
    assert art["correlation_dropped_columns"][0] == {"dropped": "actual_quality_mean",
                                                   "kept": "estimated_woba_using_speedangle_mean", "correlation": "1.000000"}


def test_one_row_cohort_drops_every_feature(spark):
    df = spark.createDataFrame([(1, 2023, "batter", "A", 0.5, 0.3)],
                               "player_id long, year int, role string, player_name string, feature_a double, woba_value_mean double")
    frame, art = _one(gd.preprocess_cohorts(df))
    assert art["feature_columns"] == [] and art["near_zero_variance_dropped_columns"] == ["feature_a"]
    assert frame.count() == 1


def test_pick_drop_rules():
    def lost(a, b, protect=()):
        return [x[0] for x in gd.correlated_losers([(a, b, 0.99)], protect)]

    assert lost("estimated_x", "b") == ["b"]
    assert lost("a", "xwoba_b") == ["a"]
    assert lost("def_adj_estimated_rate", "zzz") == ["zzz"]
    assert lost("aa", "bb") == ["bb"]
    assert lost("aa", "bb", ("bb",)) == ["aa"] and lost("aa", "bb", ("aa", "bb")) == []


def test_greedy_skips_pairs_with_dropped_member():
    pairs = [("a", "b", 0.99), ("a", "c", -0.98), ("b", "c", 0.99)]
    assert gd.correlated_losers(pairs) == [("b", "a", 0.99), ("c", "a", 0.98)]


def test_correlation_matches_numpy_and_constant_is_null(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    x[:, 1] = x[:, 0] * 0.5 + rng.normal(size=40) * 0.1
    rows = [(0, float(a), float(b), float(c), 1.0) for a, b, c in x]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, k double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in gd.correlation_long(df, ("g",), ["a", "b", "c", "k"]).collect()}
    ref = np.corrcoef(x.T)
    assert got[("a", "b")] == pytest.approx(ref[0, 1], abs=1e-12)
    assert got[("b", "c")] == pytest.approx(ref[1, 2], abs=1e-12)
    assert got[("a", "k")] is None


def test_nan_check_raises(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "player_id long, f double")
    with pytest.raises(ValueError):
        gd.assert_no_missing(df)
    assert gd.missing_value_report(df.fillna(0.0)) == {}
    assert df.select(F.lit(1)).count() == 2


def test_missing_values_of_all_cohorts_in_one_job(spark):
    a = spark.createDataFrame([(1, "x", 1.0, 2), (2, "y", None, 3), (3, "z", float("nan"), None)], "player_id long, role string, a double, b int")
    b = spark.createDataFrame([(1, 5.0)], "player_id long, c double")
    none = spark.createDataFrame([("only text",)], "role string")
    assert gd.missing_by_cohort({("batter", 1): a, ("batter", 2): b, ("pitcher", 1): none}) == {("batter", 1): {"a": 2, "b": 1}}
    assert gd.missing_by_cohort({}) == {} and gd.missing_by_cohort({("batter", 2): b.limit(0)}) == {}
