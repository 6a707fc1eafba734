"""Player-year feature aggregates.

Each *family* lists features (:mod:`.measures`) and, when called, gives their
aggregate Columns. A role's feature table is one aggregate over all families;
players with too many pitches for a buffer of values get their interquartile ranges
from value counts (:func:`.measures.aggregated`). The same features are kept as mergeable daily states by :mod:`.season_state`. Families are
also exposed one by one (``aggregate_families``) so each can be checked in isolation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions.clean import optional_double, require_columns
from .dedupe import PITCH_KEY, dedupe_last
from .measures import MOST, Feature, Iqr, Narrow, aggregated, aggregated_in_order, by_value_counts, difference, given, maximum, mean, nothing, number, rate, spread
from .quantiles import match

Family = Callable[[DataFrame], list[Column]]


def family(listed: Callable[[DataFrame], list[Feature | Iqr]]) -> Family:
    """Called, the features' aggregate Columns; ``features`` has their definitions."""

    def columns(df: DataFrame) -> list[Column]:
        return [f.column() for f in listed(df)]

    columns.features = listed
    columns.__doc__ = listed.__doc__
    return columns

# Required input columns per role.
PITCHER_REQUIRED = (
    "pitch_type", "release_speed", "release_spin_rate", "release_extension", "pfx_x", "pfx_z",
    "zone", "description", "plate_x", "plate_z",
)
BATTER_REQUIRED = (
    "zone", "description", "launch_speed", "launch_angle", "iso_value",
    "estimated_slg_using_speedangle", "woba_value", "estimated_woba_using_speedangle",
)
# Columns that some feature of a role reads where they are there.
_OPTIONAL = (
    "game_pk", "at_bat_number", "pitch_number", "type", "description", "zone", "plate_z", "sz_bot", "sz_top", "stand", "bb_type",
    "launch_speed", "launch_angle", "hc_x", "hc_y", "estimated_woba_using_speedangle", "delta_run_exp", "sprint_speed",
)
USED = {
    "pitcher": tuple(dict.fromkeys(("pitcher", "year", *PITCHER_REQUIRED, *_OPTIONAL))),
    "batter": tuple(dict.fromkeys(("batter", "year", *BATTER_REQUIRED, *_OPTIONAL))),
}


@dataclass(frozen=True)
class FeatureParams:
    """Thresholds of the silver build (defaults are the production values)."""

    min_pitches_pitcher: int = 500
    min_pitches_batter: int = 500
    min_batted_ball_batter: int = 200
    hard_hit_speed_mph: float = 95.0
    min_pitches_per_pitch_type: int = 15
    pull_threshold_deg: float = 20.0
    barrel: fl.BarrelDef = fl.BarrelDef()


# ---------------------------------------------------------------- families


def _in_zone(df: DataFrame) -> Column:
    """In-zone flag over the zone columns that ``df`` has."""
    zone = F.col("zone") if "zone" in df.columns else F.lit(None).cast("double")
    return fl.in_zone(zone, *(c if c in df.columns else None for c in ("plate_z", "sz_bot", "sz_top")))


def discipline_family(prefix: str = "") -> Family:
    """A3: swing / zone-swing / chase / contact / whiff, all over total pitches."""

    @family
    def listed(df: DataFrame) -> list[Feature]:
        sw, iz, wh = fl.swing(), _in_zone(df), fl.whiff()
        return [
            rate(f"{prefix}swing_rate", sw),
            rate(f"{prefix}zone_swing_rate", sw & iz),
            rate(f"{prefix}chase_rate", sw & ~iz),
            rate(f"{prefix}contact_rate", sw & ~wh),
            rate(f"{prefix}whiff_rate", wh),
        ]

    return listed


@family
def zone_family(df: DataFrame) -> list[Feature]:
    """In-zone rate; edge and meatball rates over zone 1..9."""
    z = F.col("zone").try_cast("double")
    on_grid = z.between(1, 9)
    centre = z.cast("int") == 5
    return [
        rate("in_zone_rate", _in_zone(df)),
        rate("edge_percent", ~centre, on_grid),
        rate("meatball_percent", centre, on_grid),
    ]


@family
def release_family(df: DataFrame) -> list[Feature | Iqr]:
    """Release speed max; IQRs; extension / vertical movement means."""
    return [
        maximum("release_speed_max", "release_speed"),
        Iqr("release_speed_iqr", "release_speed"),
        Iqr("release_spin_rate_iqr", "release_spin_rate"),
        Iqr("pfx_x_iqr", "pfx_x"),
        mean("release_extension_mean", "release_extension"),
        Iqr("release_extension_iqr", "release_extension"),
        mean("pfx_z_mean", "pfx_z"),
        Iqr("pfx_z_iqr", "pfx_z"),
    ]


@family
def location_family(df: DataFrame) -> list[Feature]:
    """Plate location mean and population std."""
    return [
        mean("plate_x_mean", "plate_x"),
        spread("plate_x_sd", "plate_x"),
        mean("plate_z_mean", "plate_z"),
        spread("plate_z_sd", "plate_z"),
    ]


@family
def velo_split_family(df: DataFrame) -> list[Feature]:
    """Fastball vs off-speed mean velocity and difference (all NULL if a side is empty).

    Junk codes are excluded; missing types are excluded (not counted as off-speed).
    """
    pt = F.upper(F.trim(F.col("pitch_type")))
    spd = F.col("release_speed")
    valid = spd.isNotNull() & pt.isNotNull() & ~pt.isin(*fl.JUNK_PITCH_TYPES)
    fast = mean("fastball_velo_mean", "release_speed", valid & pt.isin(*fl.FASTBALL_TYPES))
    off = mean("offspeed_velo_mean", "release_speed", valid & ~pt.isin(*fl.FASTBALL_TYPES))
    return [given(fast, off), given(off, fast), difference("velo_differential", fast, off)]


@family
def first_pitch_family(df: DataFrame) -> list[Feature]:
    """First-pitch strike rate over rows with pitch_number 1."""
    if not all(c in df.columns for c in ("pitch_number", "game_pk", "at_bat_number")):
        return [nothing("first_pitch_strike_rate")]
    first = F.col("pitch_number").try_cast("double") == 1
    strike = fl.first_pitch_strike("type") if "type" in df.columns else fl.first_pitch_strike_by_description()
    return [rate("first_pitch_strike_rate", strike, first)]


def platoon_family(suffix_l: str, suffix_r: str, diff_name: str) -> Family:
    """Mean est. wOBA on balls in play vs L and vs R, and L-R (stand S excluded)."""

    @family
    def listed(df: DataFrame) -> list[Feature]:
        if "estimated_woba_using_speedangle" not in df.columns or "stand" not in df.columns:
            return [nothing(suffix_l), nothing(suffix_r), nothing(diff_name)]
        ls = "launch_speed" if "launch_speed" in df.columns else F.lit(None)
        bip = fl.ball_in_play("description", ls)
        st = fl.stand_code()
        left = mean(suffix_l, "estimated_woba_using_speedangle", bip & (st == "L"))
        right = mean(suffix_r, "estimated_woba_using_speedangle", bip & (st == "R"))
        return [left, right, difference(diff_name, left, right)]

    return listed


def batted_ball_family(suffix: str = "") -> Family:
    """Ground / line / fly / pop-up rates over non-empty bb_type."""
    kinds = {"gb_percent": "ground_ball", "ld_percent": "line_drive", "fb_percent": "fly_ball", "iffb_percent": "popup"}

    @family
    def listed(df: DataFrame) -> list[Feature]:
        if "bb_type" not in df.columns:
            return [nothing(f"{n}{suffix}") for n in kinds]
        bt = fl.bb_type_clean()
        return [rate(f"{n}{suffix}", bt == kind, bt.isNotNull()) for n, kind in kinds.items()]

    return listed


@family
def run_value_family(df: DataFrame) -> list[Feature]:
    """Optional run-value mean (NULL when the column is absent)."""
    return [mean("delta_run_exp_mean", "delta_run_exp" if "delta_run_exp" in df.columns else optional_double(df, "delta_run_exp"))]


def contact_quality_family(params: FeatureParams) -> Family:
    """Barrel and hard-hit rates over batted balls; sweet-spot rate."""

    @family
    def listed(df: DataFrame) -> list[Feature]:
        hl = fl.has_launch()
        la = F.col("launch_angle")
        return [
            rate("barrel_rate", fl.barrel(spec=params.barrel), hl),
            rate("hard_hit_rate", fl.hard_hit(threshold_mph=params.hard_hit_speed_mph), hl),
            rate("sweet_spot_percent", la.between(8.0, 32.0), la.isNotNull()),
        ]

    return listed


def spray_family(params: FeatureParams) -> Family:
    """A10: pull / opposite-field rates among valid stand + hit location."""

    @family
    def listed(df: DataFrame) -> list[Feature]:
        if not all(c in df.columns for c in ("stand", "hc_x", "hc_y")):
            return [nothing("pull_percent"), nothing("opposite_field_percent")]
        v = fl.spray_valid()
        t = params.pull_threshold_deg
        return [
            rate("pull_percent", fl.pulled(threshold_deg=t), v),
            rate("opposite_field_percent", fl.opposite(threshold_deg=t), v),
        ]

    return listed


@family
def batter_means_family(df: DataFrame) -> list[Feature | Iqr]:
    """Batted-ball and outcome means / IQRs."""
    return [
        mean("launch_speed_mean", "launch_speed"),
        Iqr("launch_speed_iqr", "launch_speed"),
        mean("launch_angle_mean", "launch_angle"),
        Iqr("launch_angle_iqr", "launch_angle"),
        mean("iso_value_mean", "iso_value"),
        mean("estimated_slg_using_speedangle_mean", "estimated_slg_using_speedangle"),
        mean("woba_value_mean", "woba_value"),
        mean("estimated_woba_using_speedangle_mean", "estimated_woba_using_speedangle"),
    ]


def pitcher_families() -> list[Family]:
    return [
        discipline_family("batter_"),
        zone_family,
        release_family,
        velo_split_family,
        location_family,
        first_pitch_family,
        platoon_family("xwoba_allowed_lhb_mean", "xwoba_allowed_rhb_mean", "platoon_xwoba_allowed_diff"),
        batted_ball_family("_allowed"),
        run_value_family,
    ]


def batter_families(params: FeatureParams) -> list[Family]:
    return [
        discipline_family(""),
        contact_quality_family(params),
        spray_family(params),
        batted_ball_family(""),
        batter_means_family,
    ]


# ---------------------------------------------------------------- drivers


def prepare_role_pitches(
    pitches: DataFrame,
    id_col: str,
    *,
    order_cols: Sequence[str] = ("game_date", "row_tiebreak"),
    dedupe: bool = True,
) -> DataFrame:
    """P4 + A1: drop rows without the role's id, keep the last copy of each pitch."""
    df = pitches.where(F.col(id_col).isNotNull())
    if dedupe:
        df = dedupe_last(df, (id_col, "year"), PITCH_KEY, order_cols)
    return df


def features_of(df: DataFrame, families: Sequence[Family]) -> list[Feature | Iqr | Column]:
    """The features of all families in order (plain Columns for families without definitions)."""
    return [f for fam in families for f in (fam.features(df) if hasattr(fam, "features") else fam(df))]


def aggregate_families(
    df: DataFrame,
    keys: Sequence[str],
    families: Sequence[Family],
    *,
    count_name: str = "n_pitches_total",
    rows_from: DataFrame | None = None,
) -> DataFrame:
    """Every family's features per key (``rows_from``: see :func:`.measures.aggregated`)."""
    return aggregated(df, keys, features_of(df, families), F.count(F.lit(1)).alias(count_name), rows_from=rows_from)


#: with more player-seasons than this, a task meets so few pitches of each that partial aggregates are no smaller than pitches
MANY = 4096


def role_features(pitches: DataFrame, id_col: str, families: Sequence[Family], order_cols: Sequence[str]) -> DataFrame:
    """The last copies of a role's pitches, aggregated by player-season.

    Few player-seasons: rows are shuffled by pitch and partial aggregates by player-season. Many: rows are shuffled
    once, by player-season, for both steps, and sorted once; conditions go through the shuffle as bits, so neither text nor
    what only they read does. Only the player-seasons too large for a task (some, as each has more than ``MOST`` rows)
    go the other way."""
    keys = (id_col, "year")
    rows = pitches.where(F.col(id_col).isNotNull())
    used = [c for c in USED[id_col] if c in rows.columns]
    counted = rows.groupBy(*keys).count()
    n_groups, n_large = counted.agg(F.count(F.lit(1)), F.count_if(F.col("count") > MOST)).first()
    extra = F.count(F.lit(1)).alias("n_pitches_total")

    def apart(part: DataFrame) -> DataFrame:
        return dedupe_last(part, keys, PITCH_KEY, order_cols).select(*used)

    if n_groups <= MANY:
        return aggregate_families(apart(rows), keys, families, rows_from=rows)
    large = F.broadcast(counted.where(F.col("count") > MOST).select(*keys))
    small = match(rows, large, keys, "left_anti") if n_large else rows
    features, narrow = features_of(small, families), Narrow()
    if any(isinstance(f, Column) for f in features):  # these may read any column
        kept = used
    else:
        features = [f.over(narrow) for f in features]
        kept = [*keys, *narrow.columns()]
    found = {n: c for n, c in narrow.columns().items() if n not in small.columns}
    # the hash takes all columns. Asking for more partitions than there are moves nothing, but a generated method ends there:
    # as one, hash and conditions are too long for the JVM's compiler (6 million pitches: 116 task seconds, 18 without the conditions)
    hashed = small.withColumn("_row_hash", F.xxhash64(*[F.col(c) for c in small.columns])).coalesce(1 << 20)
    small = hashed.withColumns(found)
    df = dedupe_last(small, keys, PITCH_KEY, order_cols, together=keys, kept=kept, hashed="_row_hash")
    out = aggregated_in_order(df, keys, features, extra)
    if not n_large:
        return out
    hot = apart(match(rows, large, keys, "left_semi"))
    return out.unionByName(by_value_counts(hot, keys, features_of(hot, families), extra))


def pitcher_features(
    pitches: DataFrame,
    params: FeatureParams = FeatureParams(),
    *,
    order_cols: Sequence[str] = ("game_date", "row_tiebreak"),
    with_pitch_types: bool = True,
) -> DataFrame:
    """Q2 for role ``pitcher``: one row per (pitcher, year) with >= min pitches."""
    require_columns(pitches, PITCHER_REQUIRED, "pitcher input")
    fams = pitcher_families()
    vocab = None
    if with_pitch_types:
        # The type vocabulary (a handful of codes) comes from a one-column distinct;
        # per-type counts and means then ride in the same aggregate as every other
        # feature, so the pitches are scanned and deduplicated once.
        from .pitch_types import type_code_aggregates, type_vocabulary

        vocab = type_vocabulary(pitches)
        fams = [*fams, lambda d: type_code_aggregates(vocab)]
    out = role_features(pitches, "pitcher", fams, order_cols)
    out = out.where(F.col("n_pitches_total") >= params.min_pitches_pitcher)
    out = out.withColumnRenamed("pitcher", "player_id").withColumn("role", F.lit("pitcher"))
    if with_pitch_types:
        from .pitch_types import maps_from_code_aggregates

        out = maps_from_code_aggregates(out, vocab, min_pitches_per_type=params.min_pitches_per_pitch_type)
    return out


def batter_features(
    pitches: DataFrame,
    params: FeatureParams = FeatureParams(),
    *,
    order_cols: Sequence[str] = ("game_date", "row_tiebreak"),
) -> DataFrame:
    """Q2 for role ``batter``: one row per (batter, year) passing both sample floors.

    Sprint speed and fielding metrics are added by ``operators.enrich``.
    """
    require_columns(pitches, BATTER_REQUIRED, "batter input")
    fams = batter_families(params)
    fams.append(lambda d: [number("_n_batted", fl.has_launch())])
    if "sprint_speed" in pitches.columns:
        fams.append(lambda d: [mean("_pitch_sprint_mean", "sprint_speed")])
    out = role_features(pitches, "batter", fams, order_cols)
    out = out.where(
        (F.col("n_pitches_total") >= params.min_pitches_batter)
        & (F.col("_n_batted") >= params.min_batted_ball_batter)
    ).drop("_n_batted")
    return out.withColumnRenamed("batter", "player_id").withColumn("role", F.lit("batter"))


# Column order of the silver rows (ids first).
PITCHER_FEATURE_ORDER = (
    "batter_swing_rate", "batter_zone_swing_rate", "batter_chase_rate", "batter_contact_rate",
    "batter_whiff_rate", "in_zone_rate", "release_speed_max", "fastball_velo_mean",
    "offspeed_velo_mean", "velo_differential", "release_speed_iqr", "release_spin_rate_iqr",
    "pfx_x_iqr", "release_extension_mean", "release_extension_iqr", "pfx_z_mean", "pfx_z_iqr",
    "plate_x_mean", "plate_x_sd", "plate_z_mean", "plate_z_sd", "edge_percent", "meatball_percent",
    "first_pitch_strike_rate", "xwoba_allowed_lhb_mean", "xwoba_allowed_rhb_mean",
    "platoon_xwoba_allowed_diff", "gb_percent_allowed", "ld_percent_allowed", "fb_percent_allowed",
    "iffb_percent_allowed", "delta_run_exp_mean",
)
BATTER_FEATURE_ORDER = (
    "swing_rate", "zone_swing_rate", "chase_rate", "contact_rate", "whiff_rate", "barrel_rate",
    "hard_hit_rate", "pull_percent", "opposite_field_percent", "gb_percent", "ld_percent",
    "fb_percent", "iffb_percent", "sweet_spot_percent", "launch_speed_mean", "launch_speed_iqr",
    "launch_angle_mean", "launch_angle_iqr", "iso_value_mean", "estimated_slg_using_speedangle_mean",
    "woba_value_mean", "estimated_woba_using_speedangle_mean",
)
