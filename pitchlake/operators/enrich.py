"""Enrichment from leaderboards and the id register.

All side inputs are small per-season leaderboards keyed by (year, player). They
are plain DataFrame joins: the optimizer broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks
at runtime), otherwise it shuffles. "Last row wins" always uses an explicit
order column (file order), computed with ``max_by`` so it combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import display_name, find_column, pct_to_fraction, to_double, to_long_id

# The eight fielding metrics attached to batter rows.
DEFENCE_METRICS = (
    "def_oaa_total",
    "def_actual_fielding_success_rate_mean",
    "def_adj_estimated_fielding_success_rate_mean",
    "def_outfield_catch_completion_rate",
    "def_arm_strength_max_mph",
    "def_pop_time_2b_sec",
    "def_framing_runs",
    "def_drs_total",
)

# Outfield catch board star tiers (outs column, opportunities column).
STAR_TIERS = tuple((f"n_fieldout_{s}stars", f"n_opp_{s}stars") for s in (5, 4, 3, 2, 1))


def _last_by(df: DataFrame, keys: Sequence[str], value: str, order_col: str) -> DataFrame:
    """One value per key: the one on the row with the greatest ``order_col``
    (``lake.with_file_order`` gives load order)."""
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.col(order_col)).alias(value))


# -------------------------------------------------------------- sprint


def sprint_lookup(board: DataFrame, *, min_opportunities: int = 10, order_col: str = "file_order") -> DataFrame:
    """(year, player_id, sprint_speed): filtered board, last row per player and year."""
    pid = find_column(board, "player_id", "mlbam_id", "mlbamid", "id")
    ss = find_column(board, "sprint_speed", "sprint_speed_ft_per_sec")
    opp = find_column(board, "opportunities", "opp", "attempts")
    if pid is None or ss is None:
        raise ValueError("sprint board needs an id and a sprint_speed column")
    df = board.select(
        F.col("year").cast("int").alias("year"),
        to_long_id(pid).alias("player_id"),
        to_double(ss).alias("sprint_speed"),
        (to_double(opp) if opp else F.lit(None).cast("double")).alias("_opp"),
        F.col(order_col),
    ).where(F.col("player_id").isNotNull() & F.col("sprint_speed").isNotNull())
    df = df.where(F.col("_opp").isNull() | (F.col("_opp") >= min_opportunities))
    return _last_by(df, ("year", "player_id"), "sprint_speed", order_col)


def attach_sprint(
    batters: DataFrame,
    board: DataFrame,
    *,
    min_opportunities: int = 10,
    pitch_mean_col: str = "_pitch_sprint_mean",
    order_col: str = "file_order",
) -> DataFrame:
    """``sprint_speed_mean``. A season with a board uses the board only (absent
    player -> NULL); a season without one falls back to the pitch-level mean."""
    lk = sprint_lookup(board, min_opportunities=min_opportunities, order_col=order_col)
    years = board.select(F.col("year").cast("int").alias("year")).distinct().withColumn("_has_board", F.lit(True))
    fallback = F.col(pitch_mean_col) if pitch_mean_col in batters.columns else F.lit(None).cast("double")
    out = (
        batters.join(lk, ["year", "player_id"], "left")
        .join(years, ["year"], "left")
        .withColumn(
            "sprint_speed_mean",
            F.when(F.col("_has_board"), F.col("sprint_speed")).otherwise(fallback),
        )
        .drop("sprint_speed", "_has_board")
    )
    if pitch_mean_col in out.columns:
        out = out.drop(pitch_mean_col)
    return out


# -------------------------------------------------------------- register


def name_map(register: DataFrame, *, order_col: str = "file_order") -> DataFrame:
    """(player_id, player_name) from the register: ``Last, First`` with one-sided
    fallback, rows without any name skipped, last row per id wins."""
    df = register.select(
        to_long_id("key_mlbam").alias("player_id"),
        display_name("name_last", "name_first").alias("player_name"),
        F.col(order_col),
    ).where(F.col("player_id").isNotNull() & F.col("player_name").isNotNull())
    return _last_by(df, ("player_id",), "player_name", order_col)


def attach_names(df: DataFrame, names: DataFrame | None, id_col: str = "player_id") -> DataFrame:
    """Left lookup; unknown id (or no register at all) -> ''."""
    if names is None:
        return df.withColumn("player_name", F.lit(""))
    nm = names.withColumnRenamed("player_id", id_col)
    base = df.drop("player_name") if "player_name" in df.columns else df
    return base.join(nm, [id_col], "left").withColumn("player_name", F.coalesce(F.col("player_name"), F.lit("")))


def id_crosswalk(register: DataFrame, *, order_col: str = "file_order") -> DataFrame:
    """(idfg, player_id) for rows with both ids; last mapping per source id wins."""
    df = register.select(
        to_long_id("key_fangraphs").alias("idfg"),
        to_long_id("key_mlbam").alias("player_id"),
        F.col(order_col),
    ).where(F.col("idfg").isNotNull() & F.col("player_id").isNotNull())
    return _last_by(df, ("idfg",), "player_id", order_col)


# -------------------------------------------------------------- fielding sources


def oaa_rollup(oaa: DataFrame) -> DataFrame:
    """OAA summed over positions (NULL if all missing); mean parsed success rates."""
    pid = find_column(oaa, "player_id")
    val = find_column(oaa, "outs_above_average")
    act = find_column(oaa, "actual_success_rate_formatted")
    adj = find_column(oaa, "adj_estimated_success_rate_formatted")
    nul = F.lit(None).cast("double")
    return (
        oaa.select(
            F.col("year").cast("int").alias("year"),
            to_long_id(pid).alias("player_id"),
            to_double(val).alias("_oaa"),
            (pct_to_fraction(act) if act else nul).alias("_act"),
            (pct_to_fraction(adj) if adj else nul).alias("_adj"),
        )
        .where(F.col("player_id").isNotNull())
        .groupBy("year", "player_id")
        .agg(
            F.sum("_oaa").alias("def_oaa_total"),
            F.avg("_act").alias("def_actual_fielding_success_rate_mean"),
            F.avg("_adj").alias("def_adj_estimated_fielding_success_rate_mean"),
        )
    )


def catch_completion(board: DataFrame, *, order_col: str = "file_order") -> DataFrame:
    """Outs / opportunities over the star tiers present (missing counts as 0);
    NULL with no opportunities; a repeated player keeps its last row."""
    pid = find_column(board, "player_id", "id")
    outs = F.lit(0.0)
    opps = F.lit(0.0)
    for fo, op in STAR_TIERS:
        if fo in board.columns and op in board.columns:
            outs = outs + F.coalesce(to_double(fo), F.lit(0.0))
            opps = opps + F.coalesce(to_double(op), F.lit(0.0))
    rate = F.when(opps > 0, outs / opps)
    df = board.select(
        F.col("year").cast("int").alias("year"),
        to_long_id(pid).alias("player_id"),
        rate.alias("def_outfield_catch_completion_rate"),
        F.col(order_col),
    ).where(F.col("player_id").isNotNull())
    return _last_by(df, ("year", "player_id"), "def_outfield_catch_completion_rate", order_col)


def arm_strength(board: DataFrame) -> DataFrame:
    """Max arm strength per player."""
    pid = find_column(board, "player_id")
    val = find_column(board, "max_arm_strength")
    return (
        board.select(F.col("year").cast("int").alias("year"), to_long_id(pid).alias("player_id"), to_double(val).alias("v"))
        .where(F.col("player_id").isNotNull() & F.col("v").isNotNull())
        .groupBy("year", "player_id")
        .agg(F.max("v").alias("def_arm_strength_max_mph"))
    )


def _last_present(board: DataFrame, id_aliases, value_aliases, out_name: str, order_col: str) -> DataFrame:
    pid = find_column(board, *id_aliases)
    val = find_column(board, *value_aliases)
    df = board.select(
        F.col("year").cast("int").alias("year"),
        to_long_id(pid).alias("player_id"),
        to_double(val).alias(out_name),
        F.col(order_col),
    ).where(F.col("player_id").isNotNull() & F.col(out_name).isNotNull())
    return _last_by(df, ("year", "player_id"), out_name, order_col)


def pop_time(board: DataFrame, *, order_col: str = "file_order") -> DataFrame:
    """``pop_2b_sba`` (else ``pop_2b``) column; last non-missing row wins."""
    return _last_present(board, ("entity_id", "player_id"), ("pop_2b_sba", "pop_2b"), "def_pop_time_2b_sec", order_col)


def framing_runs(board: DataFrame, *, order_col: str = "file_order") -> DataFrame:
    """``rv_tot`` (else ``framing_runs``) column; last non-missing row wins."""
    return _last_present(board, ("id", "player_id"), ("rv_tot", "framing_runs"), "def_framing_runs", order_col)


def drs_total(board: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """A26 + J3: DRS summed per source id (NULL if all missing), season-filtered when
    a season column exists, mapped to player ids (unmapped dropped). Several source
    ids on one player: the largest source id wins."""
    idc = find_column(board, "IDfg", "idfg")
    drs = find_column(board, "DRS", "drs")
    season = find_column(board, "Season", "season")
    df = board
    if season:
        df = df.where(to_double(season) == F.col("year").cast("double"))
    sums = (
        df.select(F.col("year").cast("int").alias("year"), to_long_id(idc).alias("idfg"), to_double(drs).alias("drs"))
        .where(F.col("idfg").isNotNull())
        .groupBy("year", "idfg")
        .agg(F.sum("drs").alias("drs"))
    )
    mapped = sums.join(crosswalk, ["idfg"], "inner")
    return mapped.groupBy("year", "player_id").agg(F.max_by(F.col("drs"), F.col("idfg")).alias("def_drs_total"))


def fielding_metrics(
    *,
    oaa: DataFrame | None = None,
    catch: DataFrame | None = None,
    arm: DataFrame | None = None,
    poptime: DataFrame | None = None,
    framing: DataFrame | None = None,
    fielding: DataFrame | None = None,
    crosswalk: DataFrame | None = None,
) -> DataFrame | None:
    """Six per-source aggregates merged per (year, player_id).

    Instead of five chained full outer joins, the sources are stacked with
    ``unionByName(allowMissingColumns=True)`` and collapsed by one aggregate:
    each metric comes from exactly one source row, so ``max`` picks it. One
    shuffle instead of five.
    """
    parts: list[DataFrame] = []
    if oaa is not None:
        parts.append(oaa_rollup(oaa))
    if catch is not None:
        parts.append(catch_completion(catch))
    if arm is not None:
        parts.append(arm_strength(arm))
    if poptime is not None:
        parts.append(pop_time(poptime))
    if framing is not None:
        parts.append(framing_runs(framing))
    if fielding is not None and crosswalk is not None:
        parts.append(drs_total(fielding, crosswalk))
    if not parts:
        return None
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    for m in DEFENCE_METRICS:
        if m not in stacked.columns:
            stacked = stacked.withColumn(m, F.lit(None).cast("double"))
    return stacked.groupBy("year", "player_id").agg(*[F.max(F.col(m).cast("double")).alias(m) for m in DEFENCE_METRICS])


def attach_fielding(batters: DataFrame, metrics: DataFrame | None) -> DataFrame:
    """Left join; unmatched batters get the eight metrics as NULL."""
    if metrics is None:
        out = batters
        for m in DEFENCE_METRICS:
            out = out.withColumn(m, F.lit(None).cast("double"))
        return out
    return batters.join(metrics, ["year", "player_id"], "left")
