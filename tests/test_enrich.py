"""Leaderboard / register enrichment."""

import pytest
from pyspark.sql import functions as F

from pitchlake.functions.clean import clean_column_name, find_column, pct_to_fraction
from pitchlake.operators import enrich as en


def test_display_names(spark):
    reg = spark.createDataFrame([(123, "Smith", "John", 1), (456, "Lee", "", 2), (789, " ", None, 3), (None, "X", "Y", 4)],
                                "key_mlbam long, name_last string, name_first string, o int")
    got = {r["player_id"]: r["player_name"] for r in en.name_map(reg, order_col="o").collect()}
    assert got == {123: "Smith, John", 456: "Lee"}
    rows = spark.createDataFrame([(123,), (456,), (999,)], "player_id long")
    named = {r["player_id"]: r["player_name"] for r in en.attach_names(rows, en.name_map(reg, order_col="o")).collect()}
    assert named == {123: "Smith, John", 456: "Lee", 999: ""}
    assert {r["player_name"] for r in en.attach_names(rows, None).collect()} == {""}


def test_sprint_year_with_board_never_falls_back(spark):
    board = spark.createDataFrame([(2023, 999, 28.5, 50, 1), (2023, 999, 29.0, 5, 2), (2023, 1, 27.0, None, 3)],
                                  "year int, mlbam_id long, sprint_speed double, opp int, file_order int")
    bat = spark.createDataFrame([(999, 2023, 20.0), (555, 2023, 21.0), (555, 2024, 22.0)],
                                "player_id long, year int, _pitch_sprint_mean double")
    got = {(r["player_id"], r["year"]): r["sprint_speed_mean"] for r in en.attach_sprint(bat, board).collect()}
    # 999: the second row has too few opportunities -> first row; 555 in 2023: board year, absent -> NULL;
    # 2024 has no board -> pitch-level mean.
    assert got == {(999, 2023): 28.5, (555, 2023): None, (555, 2024): 22.0}


def test_percent_parse(spark):
    df = spark.createDataFrame([("87%",), (" 12 %",), ("n/a",), (None,), ("50",)], "s string")
    got = [r[0] for r in df.select(pct_to_fraction("s")).collect()]
    assert got[0] == pytest.approx(0.87) and got[1] == pytest.approx(0.12) and got[2] is None and got[3] is None
    assert got[4] == pytest.approx(0.5)


def test_column_helpers():
    assert clean_column_name(" Player ID (MLBAM) ") == "player_id_mlbam"
    assert find_column(["Player_ID", "DRS"], "idfg", "player_id") == "Player_ID"
    assert find_column(["a"], "b") is None


def test_fielding_merge_and_last_wins(spark):
    board = spark.createDataFrame(
        [(2023, 10, 5000, 3, "80%", "70%", 2, 4, 90.0, 1.9, 2.0, 1.0, 1),
         (2023, 10, 5001, None, "90%", "n/a", 0, 0, 91.0, None, 3.0, None, 2),
         (2023, 11, 5002, None, None, None, 1, 1, None, 2.0, None, 4.0, 3)],
        "year int, player_id long, idfg long, outs_above_average int, actual_success_rate_formatted string, "
        "adj_estimated_success_rate_formatted string, n_fieldout_5stars int, n_opp_5stars int, max_arm_strength double, "
        "pop_2b_sba double, rv_tot double, drs double, file_order int")
    reg = spark.createDataFrame([(10, 5000, 1), (10, 5001, 2), (11, 5002, 3)], "key_mlbam long, key_fangraphs long, file_order int")
    m = en.fielding_metrics(oaa=board, catch=board, arm=board, poptime=board, framing=board, fielding=board,
                            crosswalk=en.id_crosswalk(reg))
    got = {r["player_id"]: r.asDict() for r in m.collect()}
    a = got[10]
    assert a["def_oaa_total"] == 3.0
    assert a["def_actual_fielding_success_rate_mean"] == pytest.approx(0.85)
    assert a["def_adj_estimated_fielding_success_rate_mean"] == pytest.approx(0.70)
    assert a["def_outfield_catch_completion_rate"] is None  # last row has no opportunities
    assert a["def_arm_strength_max_mph"] == 91.0
    assert a["def_pop_time_2b_sec"] == pytest.approx(1.9)  # last non-missing
    assert a["def_framing_runs"] == 3.0
    # two source ids map to one player: the larger id wins even though its sum is missing
    assert a["def_drs_total"] is None
    b = got[11]
    assert b["def_oaa_total"] is None and b["def_outfield_catch_completion_rate"] == 1.0 and b["def_drs_total"] == 4.0


def test_batter_without_fielding_gets_null_metrics(spark):
    bat = spark.createDataFrame([(1, 2023)], "player_id long, year int")
    out = en.attach_fielding(bat, None).first().asDict()
    assert all(out[m] is None for m in en.DEFENCE_METRICS)
