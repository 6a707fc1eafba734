"""Registered queries: Spark implementation + DuckDB oracle text, side by side.

Every query reads the driver's whole tables (through the fixture projections)
and returns a DataFrame. Doubles are rounded to 10 decimals on both sides so the
order-insensitive value hash of the two engines can agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def finalize(df: DataFrame, digits: int = 10) -> DataFrame:
    """Round every double column (also inside nothing nested) for stable hashing."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = 10) -> str:
    return f"ROUND({expr}, {digits})"


# Oracle building blocks ------------------------------------------------------

def dedup_cte(role_id: str) -> str:
    return (
        f"d AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {role_id}, year, game_pk, pitch_number, "
        f"at_bat_number ORDER BY game_date DESC, row_tiebreak DESC) AS rn FROM pitches WHERE {role_id} IS NOT NULL) q "
        f"WHERE rn = 1)"
    )


def flags_cte(src: str = "d") -> str:
    return f"""f AS (SELECT *,
   (contains(LOWER(COALESCE(description, '')), 'swinging_strike') OR contains(LOWER(COALESCE(description, '')), 'foul')
    OR contains(LOWER(COALESCE(description, '')), 'hit_into_play') OR contains(LOWER(COALESCE(description, '')), 'missed_bunt')
    OR contains(LOWER(COALESCE(description, '')), 'bunt_foul')) AS swing,
   contains(LOWER(COALESCE(description, '')), 'swinging_strike') AS whiff_raw,
   COALESCE(CAST(zone AS DOUBLE) BETWEEN 1 AND 9, plate_z >= sz_bot AND plate_z <= sz_top, FALSE) AS in_zone,
   UPPER(TRIM(COALESCE(stand, ''))) AS st,
   (contains(LOWER(COALESCE(description, '')), 'hit_into_play') OR launch_speed IS NOT NULL) AS bip,
   NULLIF(TRIM(LOWER(bb_type)), '') AS bt,
   DEGREES(ATAN2(hc_x - 125.42, 198.27 - hc_y)) AS spray
 FROM {src})"""


def rate_sql(flag: str, where: str | None = None) -> str:
    one = f"CASE WHEN {flag} THEN 1E0 ELSE 0E0 END"
    if where is None:
        return f"AVG({one})"
    return f"AVG(CASE WHEN {where} THEN {one} END)"


def iqr_sql(c: str) -> str:
    return f"CASE WHEN COUNT({c}) >= 2 THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END"
