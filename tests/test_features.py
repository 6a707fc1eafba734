"""Silver feature operators: flags, traps, identities, reference-style unit cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import flags as fl
from pitchlake.functions.aggs import iqr, rate
from pitchlake.operators import dedupe, features as ft, pitch_types as ptm

PITCH_SCHEMA = (
    "game_pk long, at_bat_number int, pitch_number int, pitcher long, batter long, game_date date, year int, "
    "pitch_type string, release_speed double, release_spin_rate double, release_extension double, pfx_x double, "
    "pfx_z double, zone int, plate_x double, plate_z double, sz_bot double, sz_top double, description string, "
    "launch_speed double, launch_angle double, hc_x double, hc_y double, stand string, bb_type string, type string, "
    "iso_value double, estimated_slg_using_speedangle double, woba_value double, "
    "estimated_woba_using_speedangle double, delta_run_exp double, row_tiebreak long"
)


def _pitcher_frame(spark, n=600, seed=0, pid=123):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((
            int(i // 5), int(1 + i % 9), int(1 + i % 5), pid, int(900 + i % 7), dt.date(2024, 4, 1), 2024,
            ["FF", "SL", "CH"][i % 3], float(rng.normal(93, 3)), float(rng.normal(2200, 150)), float(rng.normal(6.3, 0.2)),
            float(rng.normal(0, 5)), float(rng.normal(10, 4)), int(i % 14), float(rng.normal(0, 0.8)), float(rng.normal(2.5, 0.7)),
            1.5, 3.5, "swinging_strike", None, None, None, None, "R", None, "S",
            0.1, 0.2, 0.3, 0.35, float(rng.normal(0, 0.1)), i,
        ))
    return spark.createDataFrame(rows, PITCH_SCHEMA)


def test_pitcher_row_exists_with_count(spark):
    df = _pitcher_frame(spark)
    out = ft.pitcher_features(df, ft.FeatureParams(min_pitches_pitcher=100)).collect()
    assert len(out) == 1
    r = out[0]
    assert r["player_id"] == 123 and r["year"] == 2024 and r["role"] == "pitcher"
    assert r["n_pitches_total"] == 600
    assert r["batter_swing_rate"] == pytest.approx(1.0)
    assert r["pitch_type_entropy"] == pytest.approx(math.log(3), rel=1e-9)
    assert set(r["pitch_type_shares"].keys()) == {"FF", "SL", "CH"}


def test_pitcher_below_floor_gives_no_row(spark):
    df = _pitcher_frame(spark, n=50)
    assert ft.pitcher_features(df, ft.FeatureParams(min_pitches_pitcher=100)).count() == 0


def test_missing_required_column_raises(spark):
    df = _pitcher_frame(spark, n=10).drop("pfx_z")
    with pytest.raises(ValueError, match="missing required"):
        ft.pitcher_features(df)


def test_identities_on_fixture(spark):
    from pitchlake import fixtures as fx

    p = fx.pitches(spark, "/root/testdata/sf0.001")
    df = ft.aggregate_families(ft.prepare_role_pitches(p, "pitcher"), ("pitcher", "year"),
                               [ft.discipline_family(""), ft.zone_family])
    bad = df.where(
        (F.abs(F.col("swing_rate") - F.col("zone_swing_rate") - F.col("chase_rate")) > 1e-12)
        | (F.abs(F.col("swing_rate") - F.col("contact_rate") - F.col("whiff_rate")) > 1e-12)
        | (F.abs(F.col("edge_percent") + F.col("meatball_percent") - 1) > 1e-12)
    )
    assert df.count() > 0 and bad.count() == 0


def test_in_zone_rules(spark):
    rows = [(5, None, 1.5, 3.5), (12, 2.0, 1.5, 3.5), (None, 2.0, 1.5, 3.5), (None, 4.0, 1.5, 3.5), (None, None, 1.5, 3.5)]
    df = spark.createDataFrame(rows, "zone int, plate_z double, sz_bot double, sz_top double")
    got = [r[0] for r in df.select(fl.in_zone()).collect()]
    assert got == [True, False, True, False, False]


def test_swing_uses_contains_not_like(spark):
    df = spark.createDataFrame([("foul",), ("Foul_Tip",), ("ball",), ("called_strike",), (None,), ("bunt_foul_tip",)], "description string")
    got = [r[0] for r in df.select(fl.swing()).collect()]
    assert got == [True, True, False, False, False, True]


def test_rate_nan_never_produced_and_missing_flag_counts_as_false(spark):
    df = spark.createDataFrame([(1, None), (1, 99.0), (1, 50.0)], "g int, launch_speed double").withColumn("launch_angle", F.lit(28.0))
    r = df.groupBy("g").agg(rate(fl.barrel()).alias("all"), rate(fl.barrel(), fl.has_launch()).alias("bip")).first()
    assert r["all"] == pytest.approx(1 / 3) and r["bip"] == pytest.approx(1 / 2)


def test_iqr_matches_numpy_and_needs_two_values(spark):
    vals = [1.0, 2.0, 4.0, 7.0, 11.0, 16.0]
    df = spark.createDataFrame([(1, v) for v in vals] + [(2, 5.0)], "g int, x double")
    got = {r["g"]: r["q"] for r in df.groupBy("g").agg(iqr("x").alias("q")).collect()}
    assert got[1] == pytest.approx(np.percentile(vals, 75) - np.percentile(vals, 25))
    assert got[2] is None


def test_velo_split_all_missing_when_one_side_empty(spark):
    rows = [(1, "FF", 95.0), (1, "SI", 94.0), (2, "FF", 95.0), (2, "sl ", 85.0), (2, "UN", 70.0), (2, None, 60.0)]
    df = spark.createDataFrame(rows, "g int, pitch_type string, release_speed double")
    got = {r["g"]: r for r in df.groupBy("g").agg(*ft.velo_split_family(df)).collect()}
    assert got[1]["fastball_velo_mean"] is None and got[1]["velo_differential"] is None
    assert got[2]["offspeed_velo_mean"] == pytest.approx(85.0) and got[2]["velo_differential"] == pytest.approx(10.0)


def test_first_pitch_strike_rules(spark):
    rows = [(1, 1, 1, "S"), (1, 2, 1, "B"), (1, 3, 1, None), (1, 4, 2, "S")]
    df = spark.createDataFrame(rows, "g int, game_pk int, pitch_number int, type string").withColumn("at_bat_number", F.lit(1))
    r = df.groupBy("g").agg(*ft.first_pitch_family(df)).first()
    assert r[1] == pytest.approx(1 / 3)
    no_keys = df.drop("game_pk")
    assert no_keys.groupBy("g").agg(*ft.first_pitch_family(no_keys)).first()[1] is None


def test_spray_classes(spark):
    # x > home -> positive angle: pulled for L, opposite for R
    rows = [("R", 200.0, 100.0), ("L", 200.0, 100.0), ("r ", 125.42, 100.0), ("S", 200.0, 100.0)]
    df = spark.createDataFrame(rows, "stand string, hc_x double, hc_y double")
    got = df.select(fl.pulled().alias("p"), fl.opposite().alias("o"), fl.spray_valid().alias("v")).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (True, False, True), (False, False, True), (False, False, False)]


def test_dedupe_keeps_last_and_one_per_key(spark):
    rows = [(1, 1, 1, 7, dt.date(2024, 4, 1), 1, "a"), (1, 1, 1, 7, dt.date(2024, 4, 2), 0, "b"),
            (1, 1, 1, 7, dt.date(2024, 4, 2), 0, "b"), (1, 1, 1, 8, dt.date(2024, 4, 1), 0, "c"),
            (2, None, 1, 7, dt.date(2024, 4, 1), 5, "d"), (2, None, 1, 7, dt.date(2024, 4, 1), 6, "e")]
    df = spark.createDataFrame(rows, "game_pk long, pitch_number int, at_bat_number int, pitcher long, game_date date, row_tiebreak long, tag string")
    out = dedupe.dedupe_last(df, ("pitcher",)).orderBy("game_pk", "pitcher").collect()
    assert [r["tag"] for r in out] == ["b", "c", "e"]


def test_dedupe_noop_without_keys(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "pitcher long, tag string")
    assert dedupe.dedupe_last(df, ("pitcher",)).count() == 2


def test_entropy_single_type_is_zero_and_widen(spark):
    df = spark.createDataFrame([(1, 2024, "FF")] * 20 + [(2, 2024, "FF")] * 10 + [(2, 2024, "SL")] * 10,
                               "pitcher long, year int, pitch_type string")
    ent = {r["pitcher"]: r["pitch_type_entropy"] for r in ptm.pitch_type_entropy(df, "pitcher").collect()}
    assert ent[1] == 0.0 and ent[2] == pytest.approx(math.log(2))


def test_normalize_bronze_nan_to_null_and_ids(spark):
    from pitchlake.functions.clean import normalize_bronze

    df = spark.createDataFrame([("7", "x", dt.date(2024, 5, 1), float("nan")), ("8.0", "9", dt.date(2024, 5, 2), 99.0)],
                               "pitcher string, batter string, date date, release_speed double")
    out = normalize_bronze(df).orderBy("game_date").collect()
    assert out[0]["release_speed"] is None and out[0]["batter"] is None and out[0]["pitcher"] == 7
    assert out[1]["pitcher"] == 8 and out[1]["year"] == 2024 and "game_date" in out[0].asDict()
    # NaN would otherwise satisfy ">= 98" in Spark and poison avg/max
    nan_df = spark.createDataFrame([(float("nan"),), (50.0,)], "launch_speed double")
    assert normalize_bronze(nan_df.withColumn("game_date", F.lit(dt.date(2024, 1, 1)))).agg(F.max("launch_speed")).first()[0] == 50.0


def test_empty_domains_give_null_not_errors(spark):
    # ANSI mode is on: every rate divides by its own domain size and must be NULL, never raise
    df = spark.createDataFrame([(1, None, None, None, "R", None, None, None)],
                               "g int, launch_speed double, launch_angle double, bb_type string, stand string, hc_x double, hc_y double, zone int")
    params = ft.FeatureParams()
    r = df.groupBy("g").agg(*ft.contact_quality_family(params)(df), *ft.batted_ball_family("")(df),
                           *ft.spray_family(params)(df), F.lit(0).alias("_")).first()
    assert all(r[c] is None for c in ("barrel_rate", "hard_hit_rate", "sweet_spot_percent", "gb_percent", "pull_percent"))


def test_rates_stay_in_unit_interval_on_fixture(spark):
    from pitchlake import fixtures as fx
    from pitchlake.plans.silver import rate_violations

    p = fx.pitches(spark, "/root/testdata/sf0.001")
    bat = ft.batter_features(p, ft.FeatureParams(min_pitches_batter=1, min_batted_ball_batter=0))
    pit = ft.pitcher_features(p, ft.FeatureParams(min_pitches_pitcher=1), with_pitch_types=False)
    assert rate_violations(bat, "batter").count() == 0 and rate_violations(pit, "pitcher").count() == 0
