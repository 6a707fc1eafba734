"""Per-pitch boolean flags and derived measures, as Spark column expressions.

Every flag is non-NULL (missing inputs give ``false``) so that a rate computed
from it always divides by the full row count of its domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import col_, lower_text, upper_trim

# Home-plate coordinates of the hit-location grid (feet).
HC_HOME_X = 125.42
HC_HOME_Y = 198.27

# Description fragments that mark a swing.
SWING_MARKERS = ("swinging_strike", "foul", "hit_into_play", "missed_bunt", "bunt_foul")
WHIFF_MARKER = "swinging_strike"
IN_PLAY_MARKER = "hit_into_play"

# Pitch-type code sets.
FASTBALL_TYPES = ("FF", "FA", "FT", "SI", "FC")
JUNK_PITCH_TYPES = ("UN", "PO", "XX", "IN")


@dataclass(frozen=True)
class BarrelDef:
    speed_threshold_mph: float = 98.0
    launch_angle_min_deg: float = 26.0
    launch_angle_max_deg: float = 30.0


def _any_contains(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def swing(description: str | Column = "description") -> Column:
    return _any_contains(lower_text(description), SWING_MARKERS)


def whiff(description: str | Column = "description") -> Column:
    d = lower_text(description)
    return _any_contains(d, SWING_MARKERS) & F.contains(d, F.lit(WHIFF_MARKER))


def contact(description: str | Column = "description") -> Column:
    return swing(description) & ~whiff(description)


def in_zone(zone="zone", plate_z="plate_z", sz_bot="sz_bot", sz_top="sz_top") -> Column:
    """Zone 1..9 when zone is known, else plate_z within [sz_bot, sz_top], else false."""
    z = col_(zone).try_cast("double")
    if plate_z is None or sz_bot is None or sz_top is None:  # an input without these columns
        return F.coalesce(z.between(1, 9), F.lit(False))
    geom = (col_(plate_z) >= col_(sz_bot)) & (col_(plate_z) <= col_(sz_top))
    return F.coalesce(z.between(1, 9), geom, F.lit(False))


def has_launch(speed="launch_speed", angle="launch_angle") -> Column:
    return col_(speed).isNotNull() & col_(angle).isNotNull()


def barrel(speed="launch_speed", angle="launch_angle", spec: BarrelDef = BarrelDef()) -> Column:
    s, a = col_(speed), col_(angle)
    return F.coalesce(
        has_launch(s, a)
        & (s >= F.lit(spec.speed_threshold_mph))
        & a.between(spec.launch_angle_min_deg, spec.launch_angle_max_deg),
        F.lit(False),
    )


def hard_hit(speed="launch_speed", angle="launch_angle", threshold_mph: float = 95.0) -> Column:
    s = col_(speed)
    return F.coalesce(has_launch(s, angle) & (s >= F.lit(threshold_mph)), F.lit(False))


def spray_angle(hc_x="hc_x", hc_y="hc_y") -> Column:
    """Horizontal spray angle in degrees; NULL when a coordinate is missing."""
    return F.degrees(F.atan2(col_(hc_x) - F.lit(HC_HOME_X), F.lit(HC_HOME_Y) - col_(hc_y)))


def stand_code(stand="stand") -> Column:
    return upper_trim(stand)


def spray_valid(stand="stand", hc_x="hc_x", hc_y="hc_y") -> Column:
    return stand_code(stand).isin("R", "L") & spray_angle(hc_x, hc_y).isNotNull()


def pulled(stand="stand", hc_x="hc_x", hc_y="hc_y", threshold_deg: float = 20.0) -> Column:
    s, a = stand_code(stand), spray_angle(hc_x, hc_y)
    return F.coalesce(
        F.when(s == "R", a < -threshold_deg).when(s == "L", a > threshold_deg), F.lit(False)
    )


def opposite(stand="stand", hc_x="hc_x", hc_y="hc_y", threshold_deg: float = 20.0) -> Column:
    s, a = stand_code(stand), spray_angle(hc_x, hc_y)
    return F.coalesce(
        F.when(s == "R", a > threshold_deg).when(s == "L", a < -threshold_deg), F.lit(False)
    )


def ball_in_play(description="description", launch_speed="launch_speed") -> Column:
    return F.contains(lower_text(description), F.lit(IN_PLAY_MARKER)) | col_(launch_speed).isNotNull()


def bb_type_clean(bb_type="bb_type") -> Column:
    """Lower/trim batted-ball type; NULL for missing or blank."""
    return F.nullif(F.trim(F.lower(col_(bb_type))), F.lit(""))


def pitch_type_clean(pitch_type="pitch_type") -> Column:
    """Upper/trim pitch type; NULL for missing, blank or junk codes."""
    pt = F.upper(F.trim(col_(pitch_type)))
    return F.when(pt.isNull() | (pt == "") | pt.isin(*JUNK_PITCH_TYPES), F.lit(None)).otherwise(pt)


def first_pitch_strike(type_col="type") -> Column:
    return upper_trim(type_col).isin("S", "X")


def first_pitch_strike_by_description(description="description") -> Column:
    return lower_text(description).rlike("called_strike|swinging_strike|foul|hit_into_play|missed_bunt|bunt_foul")
