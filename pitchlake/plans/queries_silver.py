"""Registered silver-feature queries over the ``pitches`` projection of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import features as ft
from ..operators import pitch_types as ptm
from ..operators.dedupe import dedupe_last
from .registry import dedup_cte, finalize, flags_cte, iqr_sql, r, rate_sql, register

P = fx.oracle_ctes("pitches")
PARAMS = ft.FeatureParams(
    min_pitches_pitcher=fx.MIN_PITCHES_PITCHER_SF001,
    min_pitches_batter=fx.MIN_PITCHES_BATTER_SF001,
    min_batted_ball_batter=fx.MIN_BATTED_BALLS_SF001,
)


def _role_pitches(spark, sf_dir, role):
    return ft.prepare_role_pitches(fx.pitches(spark, sf_dir), role)


def _family_query(role, families):
    def run(spark, sf_dir):
        df = _role_pitches(spark, sf_dir, role)
        return finalize(ft.aggregate_families(df, (role, "year"), families))

    return run


def _family_sql(role, select_list: str) -> str:
    return f"""{P}, {dedup_cte(role)}, {flags_cte()}
SELECT {role}, year, COUNT(*) AS n_pitches_total, {select_list}
FROM f GROUP BY {role}, year"""


# A1 -------------------------------------------------------------------------
register(
    "dedupe_last",
    f"""{P}, {dedup_cte('pitcher')}
SELECT pitcher, year, game_pk, pitch_number, at_bat_number, game_date, row_tiebreak, pitch_type FROM d""",
)(lambda spark, d: dedupe_last(
    fx.pitches(spark, d).where(F.col("pitcher").isNotNull()), ("pitcher", "year")
).select("pitcher", "year", "game_pk", "pitch_number", "at_bat_number", "game_date", "row_tiebreak", "pitch_type"))

# A3 -------------------------------------------------------------------------
register(
    "discipline_rates",
    _family_sql("batter", ", ".join([
        f"{r(rate_sql('swing'))} AS swing_rate",
        f"{r(rate_sql('swing AND in_zone'))} AS zone_swing_rate",
        f"{r(rate_sql('swing AND NOT in_zone'))} AS chase_rate",
        f"{r(rate_sql('swing AND NOT whiff_raw'))} AS contact_rate",
        f"{r(rate_sql('swing AND whiff_raw'))} AS whiff_rate",
    ])),
)(_family_query("batter", [ft.discipline_family("")]))

# A4, A13 --------------------------------------------------------------------
register(
    "zone_rates",
    _family_sql("pitcher", ", ".join([
        f"{r(rate_sql('in_zone'))} AS in_zone_rate",
        f"{r(rate_sql('CAST(zone AS INT) <> 5', 'CAST(zone AS DOUBLE) BETWEEN 1 AND 9'))} AS edge_percent",
        f"{r(rate_sql('CAST(zone AS INT) = 5', 'CAST(zone AS DOUBLE) BETWEEN 1 AND 9'))} AS meatball_percent",
    ])),
)(_family_query("pitcher", [ft.zone_family]))

# A5, A6, A8 -----------------------------------------------------------------
register(
    "iqr_features",
    _family_sql("pitcher", ", ".join([
        f"{r('MAX(release_speed)')} AS release_speed_max",
        f"{r(iqr_sql('release_speed'))} AS release_speed_iqr",
        f"{r(iqr_sql('release_spin_rate'))} AS release_spin_rate_iqr",
        f"{r(iqr_sql('pfx_x'))} AS pfx_x_iqr",
        f"{r('AVG(release_extension)')} AS release_extension_mean",
        f"{r(iqr_sql('release_extension'))} AS release_extension_iqr",
        f"{r('AVG(pfx_z)')} AS pfx_z_mean",
        f"{r(iqr_sql('pfx_z'))} AS pfx_z_iqr",
    ])),
)(_family_query("pitcher", [ft.release_family]))

# A6, A7 ---------------------------------------------------------------------
register(
    "mean_sd_features",
    _family_sql("pitcher", ", ".join([
        f"{r('AVG(plate_x)')} AS plate_x_mean",
        f"{r('STDDEV_POP(plate_x)')} AS plate_x_sd",
        f"{r('AVG(plate_z)')} AS plate_z_mean",
        f"{r('STDDEV_POP(plate_z)')} AS plate_z_sd",
    ])),
)(_family_query("pitcher", [ft.location_family]))

# A10 ------------------------------------------------------------------------
SPRAY_VALID = "st IN ('R', 'L') AND spray IS NOT NULL"
register(
    "spray_rates",
    _family_sql("batter", ", ".join([
        f"{r(rate_sql("COALESCE(CASE WHEN st = 'R' THEN spray < -20 WHEN st = 'L' THEN spray > 20 END, FALSE)", SPRAY_VALID))} AS pull_percent",
        f"{r(rate_sql("COALESCE(CASE WHEN st = 'R' THEN spray > 20 WHEN st = 'L' THEN spray < -20 END, FALSE)", SPRAY_VALID))} AS opposite_field_percent",
    ])),
)(_family_query("batter", [ft.spray_family(ft.FeatureParams())]))

# A11 ------------------------------------------------------------------------
register(
    "batted_ball_rates",
    _family_sql("batter", ", ".join([
        f"{r(rate_sql(f"bt = '{v}'", 'bt IS NOT NULL'))} AS {n}"
        for v, n in (("ground_ball", "gb_percent"), ("line_drive", "ld_percent"), ("fly_ball", "fb_percent"), ("popup", "iffb_percent"))
    ])),
)(_family_query("batter", [ft.batted_ball_family("")]))

# A9, A12 --------------------------------------------------------------------
HAS_LAUNCH = "launch_speed IS NOT NULL AND launch_angle IS NOT NULL"
register(
    "barrel_hardhit",
    _family_sql("batter", ", ".join([
        f"{r(rate_sql(f'COALESCE({HAS_LAUNCH} AND launch_speed >= 98 AND launch_angle BETWEEN 26 AND 30, FALSE)', HAS_LAUNCH))} AS barrel_rate",
        f"{r(rate_sql(f'COALESCE({HAS_LAUNCH} AND launch_speed >= 95, FALSE)', HAS_LAUNCH))} AS hard_hit_rate",
        f"{r(rate_sql('launch_angle BETWEEN 8 AND 32', 'launch_angle IS NOT NULL'))} AS sweet_spot_percent",
    ])),
)(_family_query("batter", [ft.contact_quality_family(ft.FeatureParams())]))


def _sweet_spot(df):
    la = F.col("launch_angle")
    from ..functions.aggs import rate

    return [rate(la.between(8.0, 32.0), la.isNotNull()).alias("sweet_spot_percent")]


register(
    "sweet_spot",
    _family_sql("batter", f"{r(rate_sql('launch_angle BETWEEN 8 AND 32', 'launch_angle IS NOT NULL'))} AS sweet_spot_percent"),
)(_family_query("batter", [_sweet_spot]))

# A13 on its own ---------------------------------------------------------------
register(
    "edge_meatball",
    _family_sql("pitcher", ", ".join([
        f"{r(rate_sql('in_zone'))} AS in_zone_rate",
        f"{r(rate_sql('CAST(zone AS INT) <> 5', 'CAST(zone AS DOUBLE) BETWEEN 1 AND 9'))} AS edge_percent",
        f"{r(rate_sql('CAST(zone AS INT) = 5', 'CAST(zone AS DOUBLE) BETWEEN 1 AND 9'))} AS meatball_percent",
        f"{r(rate_sql('CAST(zone AS INT) <> 5', 'CAST(zone AS DOUBLE) BETWEEN 1 AND 9') + ' + ' + rate_sql('CAST(zone AS INT) = 5', 'CAST(zone AS DOUBLE) BETWEEN 1 AND 9'))} AS edge_plus_meatball",
    ])),
)(lambda spark, d: finalize(
    ft.aggregate_families(_role_pitches(spark, d, "pitcher"), ("pitcher", "year"), [ft.zone_family])
    .withColumn("edge_plus_meatball", F.col("edge_percent") + F.col("meatball_percent"))
))

# A14 ------------------------------------------------------------------------
register(
    "first_pitch_strike",
    _family_sql("pitcher", f"{r(rate_sql("UPPER(TRIM(COALESCE(type, ''))) IN ('S', 'X')", 'pitch_number = 1'))} AS first_pitch_strike_rate"),
)(_family_query("pitcher", [ft.first_pitch_family]))

# A15 ------------------------------------------------------------------------
register(
    "platoon_split",
    _family_sql("pitcher", ", ".join([
        f"{r("AVG(CASE WHEN bip AND st = 'L' THEN estimated_woba_using_speedangle END)")} AS xwoba_allowed_lhb_mean",
        f"{r("AVG(CASE WHEN bip AND st = 'R' THEN estimated_woba_using_speedangle END)")} AS xwoba_allowed_rhb_mean",
        f"{r("AVG(CASE WHEN bip AND st = 'L' THEN estimated_woba_using_speedangle END) - AVG(CASE WHEN bip AND st = 'R' THEN estimated_woba_using_speedangle END)")} AS platoon_xwoba_allowed_diff",
    ])),
)(_family_query("pitcher", [ft.platoon_family("xwoba_allowed_lhb_mean", "xwoba_allowed_rhb_mean", "platoon_xwoba_allowed_diff")]))

# A16 ------------------------------------------------------------------------
_PT = "UPPER(TRIM(pitch_type))"
_VALID = f"release_speed IS NOT NULL AND {_PT} IS NOT NULL AND {_PT} NOT IN ('UN', 'PO', 'XX', 'IN')"
_FB = f"{_VALID} AND {_PT} IN ('FF', 'FA', 'FT', 'SI', 'FC')"
_OFF = f"{_VALID} AND {_PT} NOT IN ('FF', 'FA', 'FT', 'SI', 'FC')"
_BOTH = f"COUNT(CASE WHEN {_FB} THEN 1 END) > 0 AND COUNT(CASE WHEN {_OFF} THEN 1 END) > 0"
register(
    "velo_split",
    _family_sql("pitcher", ", ".join([
        f"{r(f'CASE WHEN {_BOTH} THEN AVG(CASE WHEN {_FB} THEN release_speed END) END')} AS fastball_velo_mean",
        f"{r(f'CASE WHEN {_BOTH} THEN AVG(CASE WHEN {_OFF} THEN release_speed END) END')} AS offspeed_velo_mean",
        f"{r(f'CASE WHEN {_BOTH} THEN AVG(CASE WHEN {_FB} THEN release_speed END) - AVG(CASE WHEN {_OFF} THEN release_speed END) END')} AS velo_differential",
    ])),
)(_family_query("pitcher", [ft.velo_split_family]))

# Q2 pitcher (fixed features) --------------------------------------------------
_PITCHER_SELECT = ", ".join([
    f"{r(rate_sql('swing'))} AS batter_swing_rate",
    f"{r(rate_sql('swing AND in_zone'))} AS batter_zone_swing_rate",
    f"{r(rate_sql('swing AND NOT in_zone'))} AS batter_chase_rate",
    f"{r(rate_sql('swing AND NOT whiff_raw'))} AS batter_contact_rate",
    f"{r(rate_sql('swing AND whiff_raw'))} AS batter_whiff_rate",
    f"{r(rate_sql('in_zone'))} AS in_zone_rate",
    f"{r(rate_sql('CAST(zone AS INT) <> 5', 'CAST(zone AS DOUBLE) BETWEEN 1 AND 9'))} AS edge_percent",
    f"{r(rate_sql('CAST(zone AS INT) = 5', 'CAST(zone AS DOUBLE) BETWEEN 1 AND 9'))} AS meatball_percent",
    f"{r('MAX(release_speed)')} AS release_speed_max",
    f"{r(iqr_sql('release_speed'))} AS release_speed_iqr",
    f"{r(iqr_sql('release_spin_rate'))} AS release_spin_rate_iqr",
    f"{r(iqr_sql('pfx_x'))} AS pfx_x_iqr",
    f"{r('AVG(release_extension)')} AS release_extension_mean",
    f"{r(iqr_sql('release_extension'))} AS release_extension_iqr",
    f"{r('AVG(pfx_z)')} AS pfx_z_mean",
    f"{r(iqr_sql('pfx_z'))} AS pfx_z_iqr",
    f"{r(f'CASE WHEN {_BOTH} THEN AVG(CASE WHEN {_FB} THEN release_speed END) END')} AS fastball_velo_mean",
    f"{r(f'CASE WHEN {_BOTH} THEN AVG(CASE WHEN {_OFF} THEN release_speed END) END')} AS offspeed_velo_mean",
    f"{r(f'CASE WHEN {_BOTH} THEN AVG(CASE WHEN {_FB} THEN release_speed END) - AVG(CASE WHEN {_OFF} THEN release_speed END) END')} AS velo_differential",
    f"{r('AVG(plate_x)')} AS plate_x_mean",
    f"{r('STDDEV_POP(plate_x)')} AS plate_x_sd",
    f"{r('AVG(plate_z)')} AS plate_z_mean",
    f"{r('STDDEV_POP(plate_z)')} AS plate_z_sd",
    f"{r(rate_sql("UPPER(TRIM(COALESCE(type, ''))) IN ('S', 'X')", 'pitch_number = 1'))} AS first_pitch_strike_rate",
    f"{r("AVG(CASE WHEN bip AND st = 'L' THEN estimated_woba_using_speedangle END)")} AS xwoba_allowed_lhb_mean",
    f"{r("AVG(CASE WHEN bip AND st = 'R' THEN estimated_woba_using_speedangle END)")} AS xwoba_allowed_rhb_mean",
    f"{r("AVG(CASE WHEN bip AND st = 'L' THEN estimated_woba_using_speedangle END) - AVG(CASE WHEN bip AND st = 'R' THEN estimated_woba_using_speedangle END)")} AS platoon_xwoba_allowed_diff",
] + [
    f"{r(rate_sql(f"bt = '{v}'", 'bt IS NOT NULL'))} AS {n}_allowed"
    for v, n in (("ground_ball", "gb_percent"), ("line_drive", "ld_percent"), ("fly_ball", "fb_percent"), ("popup", "iffb_percent"))
] + [f"{r('AVG(delta_run_exp)')} AS delta_run_exp_mean"])

register(
    "pitcher_features",
    f"""{P}, {dedup_cte('pitcher')}, {flags_cte()}
SELECT pitcher AS player_id, year, 'pitcher' AS role, COUNT(*) AS n_pitches_total, {_PITCHER_SELECT}
FROM f GROUP BY pitcher, year HAVING COUNT(*) >= {PARAMS.min_pitches_pitcher}""",
)(lambda spark, d: finalize(ft.pitcher_features(fx.pitches(spark, d), PARAMS, with_pitch_types=False)))

# Q2 batter (pitch-derived features) --------------------------------------------
_BATTER_SELECT = ", ".join([
    f"{r(rate_sql('swing'))} AS swing_rate",
    f"{r(rate_sql('swing AND in_zone'))} AS zone_swing_rate",
    f"{r(rate_sql('swing AND NOT in_zone'))} AS chase_rate",
    f"{r(rate_sql('swing AND NOT whiff_raw'))} AS contact_rate",
    f"{r(rate_sql('swing AND whiff_raw'))} AS whiff_rate",
    f"{r(rate_sql(f'COALESCE({HAS_LAUNCH} AND launch_speed >= 98 AND launch_angle BETWEEN 26 AND 30, FALSE)', HAS_LAUNCH))} AS barrel_rate",
    f"{r(rate_sql(f'COALESCE({HAS_LAUNCH} AND launch_speed >= 95, FALSE)', HAS_LAUNCH))} AS hard_hit_rate",
    f"{r(rate_sql('launch_angle BETWEEN 8 AND 32', 'launch_angle IS NOT NULL'))} AS sweet_spot_percent",
    f"{r(rate_sql("COALESCE(CASE WHEN st = 'R' THEN spray < -20 WHEN st = 'L' THEN spray > 20 END, FALSE)", SPRAY_VALID))} AS pull_percent",
    f"{r(rate_sql("COALESCE(CASE WHEN st = 'R' THEN spray > 20 WHEN st = 'L' THEN spray < -20 END, FALSE)", SPRAY_VALID))} AS opposite_field_percent",
] + [
    f"{r(rate_sql(f"bt = '{v}'", 'bt IS NOT NULL'))} AS {n}"
    for v, n in (("ground_ball", "gb_percent"), ("line_drive", "ld_percent"), ("fly_ball", "fb_percent"), ("popup", "iffb_percent"))
] + [
    f"{r('AVG(launch_speed)')} AS launch_speed_mean",
    f"{r(iqr_sql('launch_speed'))} AS launch_speed_iqr",
    f"{r('AVG(launch_angle)')} AS launch_angle_mean",
    f"{r(iqr_sql('launch_angle'))} AS launch_angle_iqr",
    f"{r('AVG(iso_value)')} AS iso_value_mean",
    f"{r('AVG(estimated_slg_using_speedangle)')} AS estimated_slg_using_speedangle_mean",
    f"{r('AVG(woba_value)')} AS woba_value_mean",
    f"{r('AVG(estimated_woba_using_speedangle)')} AS estimated_woba_using_speedangle_mean",
])

register(
    "batter_features",
    f"""{P}, {dedup_cte('batter')}, {flags_cte()}
SELECT batter AS player_id, year, 'batter' AS role, COUNT(*) AS n_pitches_total, {_BATTER_SELECT}
FROM f GROUP BY batter, year
HAVING COUNT(*) >= {PARAMS.min_pitches_batter} AND COUNT(CASE WHEN {HAS_LAUNCH} THEN 1 END) >= {PARAMS.min_batted_ball_batter}""",
)(lambda spark, d: finalize(ft.batter_features(fx.pitches(spark, d), PARAMS)))

# A17-A19 ----------------------------------------------------------------------
register(
    "pitch_type_shares",
    f"""{P}, {dedup_cte('pitcher')},
c AS (SELECT pitcher, year, pitch_type, COUNT(*) AS n FROM d WHERE pitch_type IS NOT NULL GROUP BY pitcher, year, pitch_type)
SELECT pitcher, year, pitch_type, n, {r('CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY pitcher, year)')} AS share FROM c""",
)(lambda spark, d: finalize(ptm.pitch_type_shares(_role_pitches(spark, d, "pitcher"), "pitcher")))

register(
    "pitch_type_entropy",
    f"""{P}, {dedup_cte('pitcher')},
c AS (SELECT pitcher, year, pitch_type, COUNT(*) AS n FROM d WHERE pitch_type IS NOT NULL GROUP BY pitcher, year, pitch_type),
s AS (SELECT pitcher, year, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY pitcher, year) AS p FROM c)
SELECT pitcher, year, {r('CASE WHEN COUNT(*) > 1 THEN -SUM(p * LN(p)) ELSE 0E0 END')} AS pitch_type_entropy
FROM s WHERE p > 0 GROUP BY pitcher, year""",
)(lambda spark, d: finalize(ptm.pitch_type_entropy(_role_pitches(spark, d, "pitcher"), "pitcher")))

register(
    "event_type_entropy",
    """WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type),
s AS (SELECT user_id, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, ROUND(CASE WHEN COUNT(*) > 1 THEN -SUM(p * LN(p)) ELSE 0E0 END, 10) AS entropy
FROM s WHERE p > 0 GROUP BY user_id""",
)(lambda spark, d: finalize(ptm.category_entropy(fx.table(spark, d, "events"), ("user_id",), "event_type")))

_PTC = "CASE WHEN UPPER(TRIM(pitch_type)) IN ('', 'UN', 'PO', 'XX', 'IN') THEN NULL ELSE UPPER(TRIM(pitch_type)) END"
register(
    "pitch_type_physical",
    f"""{P}, {dedup_cte('pitcher')}
SELECT pitcher, year, pt AS pitch_type, COUNT(*) AS n, {r('AVG(release_speed)')} AS release_speed_mean,
  {r('AVG(release_spin_rate)')} AS release_spin_rate_mean, {r('AVG(pfx_x)')} AS pfx_x_mean
FROM (SELECT *, {_PTC} AS pt FROM d) q WHERE pt IS NOT NULL GROUP BY pitcher, year, pt HAVING COUNT(*) >= 15""",
)(lambda spark, d: finalize(ptm.pitch_type_physical(_role_pitches(spark, d, "pitcher"), "pitcher", min_pitches_per_type=15)))

_SHARE_CODES = ("CH", "CU", "FF", "SI", "SL", "UN")
register(
    "pitch_type_shares_wide",
    f"""{P}, {dedup_cte('pitcher')},
c AS (SELECT pitcher, year, pitch_type, COUNT(*) AS n FROM d WHERE pitch_type IS NOT NULL GROUP BY pitcher, year, pitch_type),
s AS (SELECT pitcher, year, pitch_type, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY pitcher, year) AS share FROM c),
e AS (SELECT pitcher, year, CASE WHEN COUNT(*) > 1 THEN -SUM(share * LN(share)) ELSE 0E0 END AS ent FROM s WHERE share > 0 GROUP BY pitcher, year)
SELECT s.pitcher, s.year, {r('MAX(e.ent)')} AS pitch_type_entropy, """
    + ", ".join(f"{r(f"MAX(CASE WHEN pitch_type = '{c}' THEN share END)")} AS pitch_type_{c}_share" for c in _SHARE_CODES)
    + """
FROM s JOIN e ON s.pitcher = e.pitcher AND s.year = e.year GROUP BY s.pitcher, s.year""",
)(lambda spark, d: finalize(ptm.widen(
    ptm.pitch_type_shares(pp := _role_pitches(spark, d, "pitcher"), "pitcher"),
    ptm.pitch_type_physical(pp, "pitcher", min_pitches_per_type=15),
    ptm.pitch_type_entropy(pp, "pitcher"),
    "pitcher",
    share_codes=_SHARE_CODES,
    physical_codes=(),
)))

# Minimum slice (FIXTURES B6) ---------------------------------------------------
register(
    "min_slice",
    f"""{P}, {dedup_cte('pitcher')}, {flags_cte()}
SELECT pitcher, year, COUNT(*) AS n_pitches_total,
  {r(rate_sql('swing'))} AS swing_rate, {r(rate_sql('in_zone'))} AS in_zone_rate,
  {r(iqr_sql('release_speed'))} AS release_speed_iqr, {r('STDDEV_POP(plate_x)')} AS plate_x_sd,
  {r('AVG(estimated_woba_using_speedangle)')} AS xwoba_mean, {r('MAX(spray)')} AS max_spray_angle
FROM f GROUP BY pitcher, year""",
)(lambda spark, d: min_slice(spark, d))


def min_slice(spark, sf_dir, min_pitches: int | None = None):
    """Flagship: dedupe -> flags -> one aggregate per (pitcher, year) -> optional floor."""
    from ..functions import flags as fl
    from ..functions.aggs import iqr, rate

    df = _role_pitches(spark, sf_dir, "pitcher")
    out = df.groupBy("pitcher", "year").agg(
        F.count(F.lit(1)).alias("n_pitches_total"),
        rate(fl.swing()).alias("swing_rate"),
        rate(fl.in_zone()).alias("in_zone_rate"),
        iqr("release_speed").alias("release_speed_iqr"),
        F.stddev_pop("plate_x").alias("plate_x_sd"),
        F.avg("estimated_woba_using_speedangle").alias("xwoba_mean"),
        F.max(fl.spray_angle()).alias("max_spray_angle"),
    )
    if min_pitches is not None:
        out = out.where(F.col("n_pitches_total") >= min_pitches)
    return finalize(out)

# A8 where a group's values do not fit in one buffer: three groups of thousands of distinct values go by ranks ---------
_TENTHS = (0.1, 0.25, 0.5, 0.9)
register(
    "quantiles_by_rank",
    f"""SELECT l_returnflag, l_linestatus, COUNT(l_extendedprice) AS n, {", ".join(
        f"{r(f'quantile_cont(CAST(l_extendedprice AS DOUBLE), {p})', 6)} AS q{round(100 * p)}" for p in _TENTHS)}
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)(lambda spark, d: _quantiles_by_rank(spark, d))


def _quantiles_by_rank(spark, d):
    from ..operators import quantiles as qt

    keys = ["l_returnflag", "l_linestatus"]
    counts = qt.value_counts(fx.table(spark, d, "lineitem"), keys, {"price": "l_extendedprice"})
    got = qt.quantiles_of_counts(counts, keys, _TENTHS, most=1000)
    return finalize(got.select(*keys, "n", *[F.col("quantiles")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(_TENTHS)]), 6)
