"""Bindings of the driver's TPC-H-like test tables onto pitch / leaderboard shapes.

The projection SQL below is shared text: Spark runs it with DataFrame
parameters (``spark.sql(text, lineitem=df)``) and the DuckDB oracle runs the
same text over its registered views, so both engines see identical inputs.
Nothing here is an operator; it only shapes test data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The test-data projections (shared with the oracle SQL).
PITCHES_SQL = """
SELECT l_orderkey AS game_pk, CAST(1 + l_orderkey % 9 AS INT) AS at_bat_number, l_linenumber AS pitch_number,
  l_suppkey AS pitcher, l_partkey % 40 AS batter, CAST(l_shipdate AS DATE) AS game_date, CAST(YEAR(l_shipdate) AS INT) AS year,
  CASE WHEN l_quantity <= 15 THEN 'FF' WHEN l_quantity <= 22 THEN 'SI' WHEN l_quantity <= 30 THEN 'SL' WHEN l_quantity <= 38 THEN 'CH'
       WHEN l_quantity <= 44 THEN 'CU' WHEN l_quantity <= 47 THEN 'UN' END AS pitch_type,
  CASE WHEN x % 23 = 0 THEN NULL ELSE 78 + l_discount * 200 END AS release_speed,
  1800 + l_quantity * 20 AS release_spin_rate, 5.5E0 + l_tax * 20 AS release_extension,
  l_discount * 20 - 1 AS pfx_x, l_tax * 25 - 1 AS pfx_z,
  CASE WHEN x % 19 = 0 THEN NULL ELSE CAST(1 + x % 14 AS INT) END AS zone,
  CAST(x % 41 AS DOUBLE) / 20 - 1 AS plate_x, CAST(x % 37 AS DOUBLE) / 9 AS plate_z, 1.5E0 AS sz_bot, 3.5E0 AS sz_top,
  CASE x % 11 WHEN 0 THEN 'called_strike' WHEN 1 THEN 'ball' WHEN 2 THEN 'swinging_strike' WHEN 3 THEN 'foul' WHEN 4 THEN 'hit_into_play'
       WHEN 5 THEN 'Foul_Tip' WHEN 6 THEN 'swinging_strike_blocked' WHEN 7 THEN 'hit_into_play' WHEN 8 THEN 'missed_bunt' WHEN 9 THEN 'ball' END AS description,
  CASE WHEN x % 11 IN (3, 4, 7) THEN CAST(60 + x % 59 AS DOUBLE) END AS launch_speed,
  CASE WHEN x % 11 IN (4, 7) THEN CAST(x % 83 AS DOUBLE) - 30 END AS launch_angle,
  CASE WHEN x % 11 IN (4, 7) THEN CAST(60 + x % 131 AS DOUBLE) END AS hc_x, CASE WHEN x % 11 IN (4, 7) THEN CAST(60 + x % 127 AS DOUBLE) END AS hc_y,
  CASE x % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'r ' WHEN 2 THEN 'L' WHEN 3 THEN 'L' ELSE 'S' END AS stand,
  CASE x % 7 WHEN 0 THEN 'ground_ball' WHEN 1 THEN 'line_drive' WHEN 2 THEN 'fly_ball' WHEN 3 THEN 'popup' WHEN 4 THEN '' END AS bb_type,
  CASE x % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'B' ELSE 'X' END AS type,
  CAST(x % 701 AS DOUBLE) / 1000 AS iso_value, CAST(x % 1999 AS DOUBLE) / 1000 AS estimated_slg_using_speedangle,
  CAST(x % 1201 AS DOUBLE) / 1000 AS woba_value, CASE WHEN x % 13 = 0 THEN NULL ELSE CAST(x % 1103 AS DOUBLE) / 1000 END AS estimated_woba_using_speedangle,
  CAST(x % 307 AS DOUBLE) / 1000 - 0.15E0 AS delta_run_exp, x AS row_tiebreak
FROM (SELECT *, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS x FROM {lineitem}) t
"""

SPRINT_BOARD_SQL = """
SELECT CASE WHEN p_partkey % 7 <> 6 THEN CAST(1995 + p_partkey % 7 AS INT) END AS year,
  CASE WHEN p_partkey % 40 <> 13 THEN p_partkey % 40 END AS player_id, 23 + CAST(p_size AS DOUBLE) / 10 AS sprint_speed,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS opportunities, p_partkey AS file_order
FROM {part}
"""

FIELD_BOARD_SQL = """
SELECT CAST(1995 + p_partkey % 7 AS INT) AS year, p_partkey % 40 AS player_id, 5000 + p_partkey % 45 AS idfg,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size - 25 END AS outs_above_average,
  CASE WHEN p_size % 11 = 0 THEN 'n/a' ELSE CONCAT(CAST(p_size AS STRING), '%') END AS actual_success_rate_formatted,
  CONCAT(CAST(p_size + 20 AS STRING), ' %') AS adj_estimated_success_rate_formatted,
  p_size % 3 AS n_fieldout_5stars, p_size % 3 + p_size % 2 AS n_opp_5stars, p_size % 4 AS n_fieldout_4stars, p_size % 4 + 1 AS n_opp_4stars,
  p_size % 5 AS n_fieldout_3stars, p_size % 5 + 2 AS n_opp_3stars, p_size % 7 AS n_fieldout_2stars, p_size % 7 AS n_opp_2stars,
  0 AS n_fieldout_1stars, 0 AS n_opp_1stars, 70 + p_retailprice / 100 AS max_arm_strength,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE 1.8E0 + CAST(p_size AS DOUBLE) / 100 END AS pop_2b_sba, CAST(p_size - 20 AS DOUBLE) AS rv_tot,
  CASE WHEN p_size % 8 = 0 THEN NULL ELSE CAST(p_size - 25 AS DOUBLE) END AS drs, p_partkey AS file_order
FROM {part}
"""

REGISTER_SQL = """
SELECT CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_custkey END AS key_mlbam, c_custkey + 5000 AS key_fangraphs,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name_last,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_mktsegment END AS name_first, c_custkey AS file_order
FROM {customer}
"""

# Pitch dedupe order: the "last" row wins.
PITCH_ORDER = ("game_date", "row_tiebreak")

# Thresholds sized to the driver's scale factors (see SURVEY §7 minimum slice).
MIN_PITCHES_PITCHER_SF001 = 80
MIN_PITCHES_BATTER_SF001 = 200
MIN_BATTED_BALLS_SF001 = 35
MIN_PITCHES_PITCHER_SF0001 = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PITCHES_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def sprint_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPRINT_BOARD_SQL, part=table(spark, sf_dir, "part"))


def field_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FIELD_BOARD_SQL, part=table(spark, sf_dir, "part"))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REGISTER_SQL, customer=table(spark, sf_dir, "customer"))


def duck(sql: str) -> str:
    """The same projection text for the DuckDB oracle (plain view names)."""
    for name in ("lineitem", "part", "customer"):
        sql = sql.replace("{" + name + "}", name)
    return sql


def oracle_ctes(*names: str) -> str:
    """``WITH`` prefix defining the named fixture views for DuckDB oracle SQL."""
    texts = {
        "pitches": PITCHES_SQL,
        "sprint_board": SPRINT_BOARD_SQL,
        "field_board": FIELD_BOARD_SQL,
        "register": REGISTER_SQL,
    }
    return "WITH " + ",\n".join(f"{n} AS ({duck(texts[n]).strip()})" for n in names)
