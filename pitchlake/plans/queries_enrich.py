"""Registered enrichment queries (leaderboards over ``part``, register over ``customer``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import flags as fl
from ..functions.clean import pct_to_fraction
from ..operators import enrich as en
from ..operators import features as ft
from .queries_silver import PARAMS, _BATTER_SELECT, HAS_LAUNCH
from .registry import dedup_cte, finalize, flags_cte, r, register

_PCT = "TRY_CAST(TRIM(REPLACE(TRIM({c}), '%', '')) AS DOUBLE) / 100"

_BATTERS_SQL = f"""{dedup_cte('batter')}, {flags_cte()},
b AS (SELECT batter AS player_id, year, COUNT(*) AS n_pitches_total FROM f GROUP BY batter, year
      HAVING COUNT(*) >= {PARAMS.min_pitches_batter} AND COUNT(CASE WHEN {HAS_LAUNCH} THEN 1 END) >= {PARAMS.min_batted_ball_batter})"""


def _batters(spark, d):
    return ft.batter_features(fx.pitches(spark, d), PARAMS).select("player_id", "year", "n_pitches_total")


# J1 ----------------------------------------------------------------------------
register(
    "sprint_enrichment",
    f"""{fx.oracle_ctes('pitches', 'sprint_board')}, {_BATTERS_SQL},
lk AS (SELECT year, player_id, sprint_speed FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY year, player_id ORDER BY file_order DESC) AS rn FROM sprint_board
         WHERE player_id IS NOT NULL AND sprint_speed IS NOT NULL AND (opportunities IS NULL OR opportunities >= 10)) q WHERE rn = 1),
yb AS (SELECT DISTINCT year FROM sprint_board)
SELECT b.player_id, b.year, b.n_pitches_total, {r('CASE WHEN yb.year IS NOT NULL THEN lk.sprint_speed END')} AS sprint_speed_mean
FROM b LEFT JOIN lk ON b.year = lk.year AND b.player_id = lk.player_id LEFT JOIN yb ON b.year = yb.year""",
)(lambda spark, d: finalize(en.attach_sprint(_batters(spark, d), fx.sprint_board(spark, d))))

# J2 + P29 ------------------------------------------------------------------------
_NAMES_SQL = """nm AS (SELECT key_mlbam AS player_id,
   NULLIF(CONCAT_WS(', ', NULLIF(TRIM(name_last), ''), NULLIF(TRIM(name_first), '')), '') AS player_name
   FROM register WHERE key_mlbam IS NOT NULL)"""
register(
    "display_names",
    f"""{fx.oracle_ctes('pitches', 'register')}, {dedup_cte('pitcher')}, {_NAMES_SQL},
p AS (SELECT pitcher AS player_id, year, COUNT(*) AS n_pitches_total FROM d GROUP BY pitcher, year)
SELECT p.player_id, p.year, p.n_pitches_total, COALESCE(nm.player_name, '') AS player_name
FROM p LEFT JOIN (SELECT * FROM nm WHERE player_name IS NOT NULL) nm ON p.player_id = nm.player_id""",
)(lambda spark, d: en.attach_names(
    ft.aggregate_families(ft.prepare_role_pitches(fx.pitches(spark, d), "pitcher"), ("pitcher", "year"), [])
    .withColumnRenamed("pitcher", "player_id"),
    en.name_map(fx.register(spark, d)),
))

# J3 + A26 ------------------------------------------------------------------------
register(
    "id_crosswalk_sum",
    f"""{fx.oracle_ctes('field_board', 'register')},
cw AS (SELECT key_fangraphs AS idfg, key_mlbam AS player_id FROM register WHERE key_fangraphs IS NOT NULL AND key_mlbam IS NOT NULL),
s AS (SELECT year, idfg, SUM(drs) AS drs FROM field_board WHERE idfg IS NOT NULL GROUP BY year, idfg),
m AS (SELECT s.year, cw.player_id, s.idfg, s.drs FROM s JOIN cw ON s.idfg = cw.idfg)
SELECT year, player_id, {r('arg_max(drs, idfg)')} AS def_drs_total FROM m GROUP BY year, player_id""",
)(lambda spark, d: finalize(en.drs_total(fx.field_board(spark, d), en.id_crosswalk(fx.register(spark, d)))))

# A20, A21 -------------------------------------------------------------------------
register(
    "oaa_rollup",
    f"""{fx.oracle_ctes('field_board')}
SELECT year, player_id, {r('SUM(CAST(outs_above_average AS DOUBLE))')} AS def_oaa_total,
  {r('AVG(' + _PCT.format(c='actual_success_rate_formatted') + ')')} AS def_actual_fielding_success_rate_mean,
  {r('AVG(' + _PCT.format(c='adj_estimated_success_rate_formatted') + ')')} AS def_adj_estimated_fielding_success_rate_mean
FROM field_board WHERE player_id IS NOT NULL GROUP BY year, player_id""",
)(lambda spark, d: finalize(en.oaa_rollup(fx.field_board(spark, d))))

# P19 -------------------------------------------------------------------------------
register(
    "percent_parse",
    f"""{fx.oracle_ctes('field_board')}
SELECT file_order, actual_success_rate_formatted, {r(_PCT.format(c='actual_success_rate_formatted'))} AS actual_fraction,
  adj_estimated_success_rate_formatted, {r(_PCT.format(c='adj_estimated_success_rate_formatted'))} AS adj_fraction
FROM field_board""",
)(lambda spark, d: finalize(fx.field_board(spark, d).select(
    "file_order",
    "actual_success_rate_formatted",
    pct_to_fraction("actual_success_rate_formatted").alias("actual_fraction"),
    "adj_estimated_success_rate_formatted",
    pct_to_fraction("adj_estimated_success_rate_formatted").alias("adj_fraction"),
)))

# A22 -------------------------------------------------------------------------------
_OUTS = " + ".join(f"COALESCE(CAST(n_fieldout_{s}stars AS DOUBLE), 0)" for s in (5, 4, 3, 2, 1))
_OPPS = " + ".join(f"COALESCE(CAST(n_opp_{s}stars AS DOUBLE), 0)" for s in (5, 4, 3, 2, 1))
register(
    "catch_completion",
    f"""{fx.oracle_ctes('field_board')}
SELECT year, player_id, {r(f'arg_max(CASE WHEN ({_OPPS}) > 0 THEN ({_OUTS}) / ({_OPPS}) END, file_order)')} AS def_outfield_catch_completion_rate
FROM field_board WHERE player_id IS NOT NULL GROUP BY year, player_id""",
)(lambda spark, d: finalize(en.catch_completion(fx.field_board(spark, d))))

# J4 + J5: all six sources, merged onto batter rows ------------------------------------
_FIELD_SQL = f"""
oa AS (SELECT year, player_id, SUM(CAST(outs_above_average AS DOUBLE)) AS def_oaa_total,
   AVG({_PCT.format(c='actual_success_rate_formatted')}) AS def_actual_fielding_success_rate_mean,
   AVG({_PCT.format(c='adj_estimated_success_rate_formatted')}) AS def_adj_estimated_fielding_success_rate_mean
   FROM field_board WHERE player_id IS NOT NULL GROUP BY year, player_id),
cc AS (SELECT year, player_id, arg_max(CASE WHEN ({_OPPS}) > 0 THEN ({_OUTS}) / ({_OPPS}) END, file_order) AS def_outfield_catch_completion_rate
   FROM field_board WHERE player_id IS NOT NULL GROUP BY year, player_id),
ar AS (SELECT year, player_id, MAX(max_arm_strength) AS def_arm_strength_max_mph FROM field_board
   WHERE player_id IS NOT NULL AND max_arm_strength IS NOT NULL GROUP BY year, player_id),
pt AS (SELECT year, player_id, arg_max(pop_2b_sba, file_order) AS def_pop_time_2b_sec FROM field_board
   WHERE player_id IS NOT NULL AND pop_2b_sba IS NOT NULL GROUP BY year, player_id),
fr AS (SELECT year, player_id, arg_max(rv_tot, file_order) AS def_framing_runs FROM field_board
   WHERE player_id IS NOT NULL AND rv_tot IS NOT NULL GROUP BY year, player_id),
cw AS (SELECT key_fangraphs AS idfg, key_mlbam AS player_id FROM register WHERE key_fangraphs IS NOT NULL AND key_mlbam IS NOT NULL),
ds AS (SELECT year, idfg, SUM(drs) AS drs FROM field_board WHERE idfg IS NOT NULL GROUP BY year, idfg),
dr AS (SELECT ds.year, cw.player_id, arg_max(ds.drs, ds.idfg) AS def_drs_total FROM ds JOIN cw ON ds.idfg = cw.idfg GROUP BY ds.year, cw.player_id),
k AS (SELECT year, player_id FROM oa UNION SELECT year, player_id FROM cc UNION SELECT year, player_id FROM ar
      UNION SELECT year, player_id FROM pt UNION SELECT year, player_id FROM fr UNION SELECT year, player_id FROM dr),
fm AS (SELECT k.year, k.player_id, oa.def_oaa_total, oa.def_actual_fielding_success_rate_mean, oa.def_adj_estimated_fielding_success_rate_mean,
   cc.def_outfield_catch_completion_rate, ar.def_arm_strength_max_mph, pt.def_pop_time_2b_sec, fr.def_framing_runs, dr.def_drs_total
   FROM k LEFT JOIN oa USING (year, player_id) LEFT JOIN cc USING (year, player_id) LEFT JOIN ar USING (year, player_id)
   LEFT JOIN pt USING (year, player_id) LEFT JOIN fr USING (year, player_id) LEFT JOIN dr USING (year, player_id))"""


def _fielding(spark, d):
    fb = fx.field_board(spark, d)
    return en.fielding_metrics(
        oaa=fb, catch=fb, arm=fb, poptime=fb, framing=fb, fielding=fb, crosswalk=en.id_crosswalk(fx.register(spark, d))
    )


register(
    "fielding_merge",
    f"""{fx.oracle_ctes('pitches', 'field_board', 'register')}, {_BATTERS_SQL}, {_FIELD_SQL}
SELECT b.player_id, b.year, b.n_pitches_total, """
    + ", ".join(f"{r('fm.' + m)} AS {m}" for m in en.DEFENCE_METRICS)
    + """
FROM b LEFT JOIN fm ON b.year = fm.year AND b.player_id = fm.player_id""",
)(lambda spark, d: finalize(en.attach_fielding(_batters(spark, d), _fielding(spark, d))))

register(
    "fielding_metrics",
    f"""{fx.oracle_ctes('field_board', 'register')}, {_FIELD_SQL}
SELECT year, player_id, """ + ", ".join(f"{r(m)} AS {m}" for m in en.DEFENCE_METRICS) + " FROM fm",
)(lambda spark, d: finalize(_fielding(spark, d)))

# Position boards with schema drift, unioned by name --------------------------
register(
    "union_positions",
    f"""{fx.oracle_ctes('field_board')}
SELECT CAST(3 + file_order % 7 AS INT) AS position, year, player_id, outs_above_average,
  CASE WHEN (3 + file_order % 7) % 2 = 1 THEN actual_success_rate_formatted END AS actual_success_rate_formatted
FROM field_board""",
)(lambda spark, d: union_positions(fx.field_board(spark, d)))


def union_positions(board):
    """Split a board into its seven position boards (codes 3..9); odd positions carry
    a column even ones lack; stitch them back with ``unionByName``."""
    from functools import reduce

    parts = []
    for pos in range(3, 10):
        cols = ["year", "player_id", "outs_above_average"]
        if pos % 2 == 1:
            cols.append("actual_success_rate_formatted")
        part = board.where(F.col("file_order") % 7 == pos - 3).select(*cols).withColumn("position", F.lit(pos))
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(
        "position", "year", "player_id", "outs_above_average", "actual_success_rate_formatted"
    )


# P12 ---------------------------------------------------------------------------------
# Compared at 9 decimals: atan2 differs by an ulp between the JVM and DuckDB's libm,
# which can straddle a 10th-decimal rounding boundary (degrees of magnitude ~100).
register(
    "spray_angle",
    f"""{fx.oracle_ctes('pitches')}
SELECT game_pk, pitch_number, pitcher, {r('DEGREES(ATAN2(hc_x - 125.42, 198.27 - hc_y))', 9)} AS spray_angle_deg FROM pitches""",
)(lambda spark, d: finalize(fx.pitches(spark, d).select("game_pk", "pitch_number", "pitcher", fl.spray_angle().alias("spray_angle_deg")), 9))

# Q1-shaped batter rows: features + sprint + names + fielding ------------------------------
register(
    "batter_rows_enriched",
    f"""{fx.oracle_ctes('pitches', 'sprint_board', 'field_board', 'register')}, {dedup_cte('batter')}, {flags_cte()},
b AS (SELECT batter AS player_id, year, 'batter' AS role, COUNT(*) AS n_pitches_total, {_BATTER_SELECT}
      FROM f GROUP BY batter, year
      HAVING COUNT(*) >= {PARAMS.min_pitches_batter} AND COUNT(CASE WHEN {HAS_LAUNCH} THEN 1 END) >= {PARAMS.min_batted_ball_batter}),
lk AS (SELECT year, player_id, sprint_speed FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY year, player_id ORDER BY file_order DESC) AS rn FROM sprint_board
         WHERE player_id IS NOT NULL AND sprint_speed IS NOT NULL AND (opportunities IS NULL OR opportunities >= 10)) q WHERE rn = 1),
yb AS (SELECT DISTINCT year FROM sprint_board), {_NAMES_SQL}, {_FIELD_SQL}
SELECT b.*, {r('CASE WHEN yb.year IS NOT NULL THEN lk.sprint_speed END')} AS sprint_speed_mean,
  COALESCE(nm.player_name, '') AS player_name, """
    + ", ".join(f"{r('fm.' + m)} AS {m}" for m in en.DEFENCE_METRICS)
    + """
FROM b LEFT JOIN lk ON b.year = lk.year AND b.player_id = lk.player_id LEFT JOIN yb ON b.year = yb.year
LEFT JOIN (SELECT * FROM nm WHERE player_name IS NOT NULL) nm ON b.player_id = nm.player_id
LEFT JOIN fm ON b.year = fm.year AND b.player_id = fm.player_id""",
)(lambda spark, d: finalize(batter_rows(spark, d)))


def batter_rows(spark, d):
    from .silver import enrich_batters

    fb = fx.field_board(spark, d)
    return enrich_batters(
        ft.batter_features(fx.pitches(spark, d), PARAMS),
        sprint_board=fx.sprint_board(spark, d),
        register=fx.register(spark, d),
        oaa=fb, catch=fb, arm=fb, poptime=fb, framing=fb, fielding=fb,
    )
