"""Bronze -> silver job (Q1): per-role player-year feature tables.

One lazy plan per role: scan (partition-pruned on the date window, column
pruned) -> keep-last dedupe -> one aggregate -> leaderboard / register joins
-> range checks -> partitioned write. Nothing is collected to the driver
except row counts and the (empty, when healthy) list of range violations.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import normalize_bronze
from ..operators import enrich as en
from ..operators import features as ft
from ..sources import lake

# Columns that must lie in [0, 1].
BATTER_RATE_COLUMNS = (
    "swing_rate", "zone_swing_rate", "chase_rate", "contact_rate", "whiff_rate", "barrel_rate",
    "hard_hit_rate", "pull_percent", "opposite_field_percent", "gb_percent", "ld_percent",
    "fb_percent", "iffb_percent", "sweet_spot_percent", "def_actual_fielding_success_rate_mean",
    "def_adj_estimated_fielding_success_rate_mean", "def_outfield_catch_completion_rate",
)
PITCHER_RATE_COLUMNS = (
    "batter_swing_rate", "batter_zone_swing_rate", "batter_chase_rate", "batter_contact_rate",
    "batter_whiff_rate", "in_zone_rate", "edge_percent", "meatball_percent", "first_pitch_strike_rate",
    "gb_percent_allowed", "ld_percent_allowed", "fb_percent_allowed", "iffb_percent_allowed",
)


def effective_window(start: dt.date, end: dt.date, *, year_to_date: bool) -> tuple[dt.date, dt.date]:
    """Widen the start to Jan 1 of the earliest year touched (end unchanged)."""
    if not year_to_date:
        return start, end
    return dt.date(min(start.year, end.year), 1, 1), end


def enrich_batters(
    batters: DataFrame,
    *,
    sprint_board: DataFrame | None = None,
    register: DataFrame | None = None,
    oaa: DataFrame | None = None,
    catch: DataFrame | None = None,
    arm: DataFrame | None = None,
    poptime: DataFrame | None = None,
    framing: DataFrame | None = None,
    fielding: DataFrame | None = None,
    sprint_min_opportunities: int = 10,
) -> DataFrame:
    """J1 + J2 + J3/J4/J5 on batter feature rows."""
    out = batters
    if sprint_board is not None:
        out = en.attach_sprint(out, sprint_board, min_opportunities=sprint_min_opportunities)
    else:
        fallback = F.col("_pitch_sprint_mean") if "_pitch_sprint_mean" in out.columns else F.lit(None).cast("double")
        out = out.withColumn("sprint_speed_mean", fallback)
        if "_pitch_sprint_mean" in out.columns:
            out = out.drop("_pitch_sprint_mean")
    out = en.attach_names(out, en.name_map(register) if register is not None else None)
    crosswalk = en.id_crosswalk(register) if register is not None else None
    metrics = en.fielding_metrics(
        oaa=oaa, catch=catch, arm=arm, poptime=poptime, framing=framing, fielding=fielding, crosswalk=crosswalk
    )
    return en.attach_fielding(out, metrics)


def order_silver_columns(df: DataFrame, role: str) -> DataFrame:
    fixed = list(ft.PITCHER_FEATURE_ORDER if role == "pitcher" else ft.BATTER_FEATURE_ORDER)
    if role == "batter":
        fixed += ["sprint_speed_mean", *en.DEFENCE_METRICS]
    head = ["role", "player_id", "year", "player_name", "n_pitches_total"]
    present = [c for c in head + fixed if c in df.columns]
    rest = sorted(c for c in df.columns if c not in present)
    if "pitch_type_entropy" in rest:
        rest.remove("pitch_type_entropy")
        rest.append("pitch_type_entropy")
    return df.select(*present, *rest)


def rate_violations(df: DataFrame, role: str) -> DataFrame:
    """(player_id, year, column, value) for rates outside [0, 1]."""
    cols = [c for c in (BATTER_RATE_COLUMNS if role == "batter" else PITCHER_RATE_COLUMNS) if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "player_id bigint, year int, column string, value double")
    long = df.select("player_id", "year", *[F.col(c).cast("double") for c in cols]).unpivot(
        ["player_id", "year"], cols, "column", "value"
    )
    return long.where((F.col("value") < 0) | (F.col("value") > 1))


def silver_tables(
    bronze: DataFrame,
    params: ft.FeatureParams = ft.FeatureParams(),
    *,
    roles: Sequence[str] = ("batter", "pitcher"),
    order_cols: Sequence[str] = (lake.FILE_ORDER,),
    sprint_board: DataFrame | None = None,
    register: DataFrame | None = None,
    fielding_sources: dict[str, DataFrame] | None = None,
    with_pitch_types: bool = True,
) -> dict[str, DataFrame]:
    """Lazy silver DataFrame per role (no write)."""
    src = normalize_bronze(bronze)
    for c in ("pitcher", "batter", "game_date"):
        if c not in src.columns:
            raise ValueError(f"Column {c!r} not found in bronze data")
    out: dict[str, DataFrame] = {}
    names = en.name_map(register) if register is not None else None
    for role in roles:
        if role == "pitcher":
            df = ft.pitcher_features(src, params, order_cols=order_cols, with_pitch_types=with_pitch_types)
            df = en.attach_names(df, names)
        elif role == "batter":
            df = ft.batter_features(src, params, order_cols=order_cols)
            df = enrich_batters(df, sprint_board=sprint_board, register=register, **(fielding_sources or {}))
        else:
            raise ValueError(f"Unknown role: {role}")
        out[role] = order_silver_columns(df, role)
    return out


def build_bronze_to_silver(
    spark: SparkSession,
    *,
    bronze_root: str,
    silver_root: str,
    start_date: str,
    end_date: str,
    year_to_date: bool = True,
    params: ft.FeatureParams = ft.FeatureParams(),
    sprint_board: DataFrame | None = None,
    register: DataFrame | None = None,
    fielding_sources: dict[str, DataFrame] | None = None,
    order_cols: Sequence[str] = (lake.FILE_ORDER,),
    violations_root: str | None = None,
) -> dict:
    """Q1 with the status protocol: ``error`` / ``no_data`` / ``ok``.

    The last copy of a pitch in load order wins. Rates outside [0, 1] stop the job
    with their count per column; ``violations_root`` receives every one of them."""
    def stopped(status: str, message) -> dict:
        return {"status": status, "message": str(message), "years_written": [], "rows_written": 0}

    try:
        start, end = lake.date_window(start_date, end_date)
    except ValueError as exc:
        return stopped("error", exc)
    b_start, b_end = effective_window(start, end, year_to_date=year_to_date)
    bronze = lake.read_bronze_range(spark, bronze_root, b_start, b_end)
    if bronze is None or bronze.isEmpty():
        return stopped("no_data", f"bronze holds nothing from {b_start} to {b_end}")
    try:
        tables = silver_tables(bronze, params, sprint_board=sprint_board, register=register,
                               fielding_sources=fielding_sources, order_cols=order_cols)
    except ValueError as exc:
        return stopped("error", exc)
    # Silver tables are small (one row per player-year): keep them for the checks,
    # the counts and the write, so the bronze plan runs once per role.
    tables = {role: df.persist() for role, df in tables.items()}
    try:
        # All checks before any write (T21): one small job per role, exact counts per column.
        for role, df in tables.items():
            bad = rate_violations(df, role).groupBy("column").count().orderBy("column").collect()
            if bad:
                if violations_root:
                    lake.write_partitioned(rate_violations(df, role).withColumn("role", F.lit(role)), violations_root, ("role", "year"))
                return stopped("error", f"rates of {role} outside [0, 1]: " + ", ".join(f"{r['column']} in {r['count']} rows" for r in bad))
        rows, years = 0, set()
        for df in tables.values():
            done = lake.write_partitioned(df, silver_root, ("role", "year"), observe={"rows": F.count(F.lit(1)), "years": F.collect_set("year")})
            rows += done["rows"]
            years.update(int(y) for y in done["years"])
    finally:
        for df in tables.values():
            df.unpersist()
    return {
        "status": "ok",
        "message": f"silver: bronze window {b_start}..{b_end}, wrote {rows} rows across years {sorted(years)}",
        "years_written": sorted(years),
        "rows_written": rows,
        "bronze_start": b_start.isoformat(),
        "bronze_end": b_end.isoformat(),
    }
