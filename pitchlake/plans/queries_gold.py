"""Registered gold-layer queries over the pitcher silver table built from ``pitches``."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import enrich as en
from ..operators import features as ft
from ..operators import gold as gd
from . import silver as sv
from .queries_enrich import _FIELD_SQL, _NAMES_SQL, batter_rows
from .queries_silver import _BATTER_SELECT, _PITCHER_SELECT, HAS_LAUNCH, PARAMS
from .registry import dedup_cte, finalize, flags_cte, r, register

# Pitcher silver (fixed features), cohort = (role, year)
_SILVER_P_SQL = f"""{dedup_cte('pitcher')}, {flags_cte()},
s AS (SELECT 'pitcher' AS role, pitcher AS player_id, year, COUNT(*) AS n_pitches_total, {_PITCHER_SELECT}
      FROM f GROUP BY pitcher, year HAVING COUNT(*) >= {PARAMS.min_pitches_pitcher})"""


def pitcher_silver(spark, d):
    return finalize(sv.order_silver_columns(
        ft.pitcher_features(fx.pitches(spark, d), PARAMS, with_pitch_types=False), "pitcher"))


PITCHER_NUMERIC = ["n_pitches_total", *ft.PITCHER_FEATURE_ORDER]

# Per rate column, how many rows were checked and how many lie outside [0, 1]
register(
    "rate_range_violations",
    f"""{fx.oracle_ctes('pitches')}, {_SILVER_P_SQL}
""" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, COUNT({c}) AS n_checked, COUNT(CASE WHEN {c} < 0 OR {c} > 1 THEN 1 END) AS n_violations, "
        f"{r(f'MIN({c})')} AS min_value, {r(f'MAX({c})')} AS max_value FROM s"
        for c in sv.PITCHER_RATE_COLUMNS
    ),
)(lambda spark, d: finalize(range_summary(pitcher_silver(spark, d), "pitcher")))


def range_summary(df, role):
    cols = [c for c in (sv.PITCHER_RATE_COLUMNS if role == "pitcher" else sv.BATTER_RATE_COLUMNS) if c in df.columns]
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], cols, "column", "value")
    return long.groupBy("column").agg(
        F.count("value").alias("n_checked"),
        F.count(F.when((F.col("value") < 0) | (F.col("value") > 1), 1)).alias("n_violations"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


# P23 + P24 on enriched batter rows (NULL sprint / fielding values get filled)
_BATTER_NUMERIC = [*ft.BATTER_FEATURE_ORDER, "sprint_speed_mean", *en.DEFENCE_METRICS]
register(
    "fill_missing",
    f"""{fx.oracle_ctes('pitches', 'sprint_board', 'field_board', 'register')}, {dedup_cte('batter')}, {flags_cte()},
b AS (SELECT batter AS player_id, year, 'batter' AS role, COUNT(*) AS n_pitches_total, {_BATTER_SELECT}
      FROM f GROUP BY batter, year
      HAVING COUNT(*) >= {PARAMS.min_pitches_batter} AND COUNT(CASE WHEN {HAS_LAUNCH} THEN 1 END) >= {PARAMS.min_batted_ball_batter}),
lk AS (SELECT year, player_id, sprint_speed FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY year, player_id ORDER BY file_order DESC) AS rn FROM sprint_board
         WHERE player_id IS NOT NULL AND sprint_speed IS NOT NULL AND (opportunities IS NULL OR opportunities >= 10)) q WHERE rn = 1),
yb AS (SELECT DISTINCT year FROM sprint_board), {_NAMES_SQL}, {_FIELD_SQL},
x AS (SELECT b.*, ROUND(CASE WHEN yb.year IS NOT NULL THEN lk.sprint_speed END, 10) AS sprint_speed_mean,
  COALESCE(nm.player_name, '') AS player_name, """
    + ", ".join(f"ROUND(fm.{m}, 10) AS {m}" for m in en.DEFENCE_METRICS)
    + """
FROM b LEFT JOIN lk ON b.year = lk.year AND b.player_id = lk.player_id LEFT JOIN yb ON b.year = yb.year
LEFT JOIN (SELECT * FROM nm WHERE player_name IS NOT NULL) nm ON b.player_id = nm.player_id
LEFT JOIN fm ON b.year = fm.year AND b.player_id = fm.player_id)
SELECT player_id, year, role, player_name, n_pitches_total, """
    + ", ".join(f"COALESCE({c}, 0E0) AS {c}" for c in _BATTER_NUMERIC)
    + " FROM x",
)(lambda spark, d: fill_query(spark, d))


def fill_query(spark, d):
    rows = finalize(batter_rows(spark, d))
    out, _ = gd.fill_missing(gd.inf_to_null(rows))
    return out.select("player_id", "year", "role", "player_name", "n_pitches_total", *_BATTER_NUMERIC)


# Distinct values per column and cohort (missing counted as one value)
register(
    "nzv_stats",
    f"""{fx.oracle_ctes('pitches')}, {_SILVER_P_SQL}
""" + "\nUNION ALL\n".join(
        f"SELECT role, year, '{c}' AS column, COUNT(*) AS n_rows, "
        f"COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM s GROUP BY role, year"
        for c in PITCHER_NUMERIC
    ),
)(lambda spark, d: nzv_query(spark, d))


def nzv_query(spark, d):
    df = pitcher_silver(spark, d)
    return gd.distinct_stats(df, ("role", "year"), PITCHER_NUMERIC).select(
        "role", "year", "column", "n_rows", F.col("n_distinct").cast("bigint"))


# Pairwise |r| per cohort (constant columns give no row)
_PAIRS = list(itertools.combinations(PITCHER_NUMERIC, 2))
register(
    "corr_pairs",
    f"""{fx.oracle_ctes('pitches')}, {_SILVER_P_SQL},
c AS (""" + "\nUNION ALL\n".join(
        f"SELECT role, year, '{a}' AS col_a, '{b}' AS col_b, CORR({a}, {b}) AS rr FROM s GROUP BY role, year"
        for a, b in _PAIRS
    ) + f""")
SELECT role, year, col_a, col_b, {r('ABS(rr)')} AS abs_r FROM c WHERE rr IS NOT NULL AND NOT isnan(rr)""",
)(lambda spark, d: corr_query(spark, d))


def corr_query(spark, d):
    df = pitcher_silver(spark, d)
    long = gd.correlation_long(df, ("role", "year"), PITCHER_NUMERIC)
    return finalize(long.where(F.col("r").isNotNull()).select("role", "year", "col_a", "col_b", F.abs("r").alias("abs_r")))


# M1/M2/M3/P26 decisions: the greedy walk over correlated pairs, as a recursive query
def _decided_sql(threshold: float, ratio: float = gd.GoldConfig.near_zero_variance_unique_ratio) -> str:
    """CTEs ``s`` (filled silver), ``gone`` (role, year, rule, dropped, kept, r) and ``names``."""
    place = {c: i for i, c in enumerate(PITCHER_NUMERIC)}
    filled = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in PITCHER_NUMERIC)
    pairs = "\nUNION ALL\n".join(
        f"SELECT role, year, {place[a]} AS ia, {place[b]} AS ib, '{a}' AS a, '{b}' AS b, CORR({a}, {b}) AS rr FROM filled GROUP BY role, year" for a, b in _PAIRS
    )
    counts = "\nUNION ALL\n".join(
        f"SELECT role, year, '{c}' AS col, COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) AS n FROM filled GROUP BY role, year" for c in PITCHER_NUMERIC
    )
    rank = "struct_pack(p := NOT regexp_matches({c}, '^estimated_|xwoba|_adj_estimated_'), n := {c})"
    first = f"{rank.format(c='a')} < {rank.format(c='b')}"
    return f"""WITH RECURSIVE {fx.oracle_ctes('pitches').removeprefix('WITH ')}, {_SILVER_P_SQL},
filled AS (SELECT role, year, player_id, {filled} FROM s),
c AS ({pairs}),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY role, year ORDER BY ia, ib) AS step,
        CASE WHEN {first} THEN a ELSE b END AS kept, CASE WHEN {first} THEN b ELSE a END AS loser
      FROM c WHERE rr IS NOT NULL AND NOT isnan(rr) AND ABS(rr) >= {threshold}),
walk(role, year, step, lost) AS (
  SELECT DISTINCT role, year, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM filled
  UNION ALL
  SELECT w.role, w.year, w.step, CASE WHEN list_contains(lost, a) OR list_contains(lost, b) THEN lost ELSE list_append(lost, loser) END
  FROM walk JOIN w ON w.role = walk.role AND w.year = walk.year AND w.step = walk.step + 1),
gone1 AS (SELECT w.role, w.year, 'correlation' AS rule, loser AS dropped, kept, ABS(rr) AS r
  FROM w JOIN walk ON w.role = walk.role AND w.year = walk.year AND w.step = walk.step + 1
  WHERE NOT list_contains(lost, a) AND NOT list_contains(lost, b)),
n AS ({counts}),
gone AS (SELECT * FROM gone1 UNION ALL
  SELECT n.role, n.year, 'near_zero_variance', col, NULL, NULL FROM n
  WHERE (n_distinct <= 1 OR CAST(n_distinct AS DOUBLE) / n <= {ratio})
    AND NOT EXISTS (SELECT 1 FROM gone1 g WHERE g.role = n.role AND g.year = n.year AND g.dropped = n.col))"""


register("corr_prune_decisions", f"""{_decided_sql(0.8)}
SELECT role, year, rule, dropped, kept, printf('%.6f', r) AS correlation FROM gone""")(lambda spark, d: prune_query(spark, d))


def prune_query(spark, d):
    df = pitcher_silver(spark, d)
    decided = gd.preprocess_cohorts(df, gd.GoldConfig(correlation_threshold=0.8)).decisions
    rows = [
        (*d.cohort, d.rule, d.column, d.kept, None if d.r is None else f"{d.r:.6f}")
        for d in decided if d.rule != gd.NOT_TRAINED
    ]
    return spark.createDataFrame(rows, "role string, year int, rule string, dropped string, kept string, correlation string")


register("gold_artifacts", f"""{_decided_sql(gd.GoldConfig.correlation_threshold)},
left_over AS (SELECT n.role, n.year, col, n.n FROM n WHERE NOT regexp_full_match(col, 'xwoba_allowed_[lr]hb_mean')
  AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.role = n.role AND g.year = n.year AND g.dropped = n.col))
SELECT role, year, CAST(MAX(n) AS INT) AS row_count, CAST(COUNT(*) AS INT) AS n_features, string_agg(col, ',' ORDER BY col) AS feature_columns
FROM left_over GROUP BY role, year""")(lambda spark, d: gold_artifacts_query(spark, d))


def gold_artifacts_query(spark, d):
    df = pitcher_silver(spark, d)
    gold = gd.preprocess_cohorts(df, gd.GoldConfig())
    found = [gd.cohort_metadata(gold, key, gd.GoldConfig()) for key in gold.frames]
    rows = [(m["role"], m["year"], m["row_count"], len(m["feature_columns"]), ",".join(m["feature_columns"])) for m in found]
    return spark.createDataFrame(rows, "role string, year int, row_count int, n_features int, feature_columns string")
