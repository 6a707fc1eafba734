"""Cleaning expressions (JVM-side, codegen-friendly).

Missing values are always SQL NULL, never NaN: a NaN inside ``avg``/``max``
poisons the result and ``NaN >= x`` is true in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """Numeric coercion: bad text -> NULL, NaN -> NULL, +-inf kept."""
    x = col_(c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def to_long_id(c: str | Column) -> Column:
    """Player ids: integers and integer text exactly, other numbers cut to BIGINT, bad -> NULL."""
    x = col_(c)
    return F.coalesce(x.try_cast("bigint"), x.cast("string").try_cast("decimal(38,10)").try_cast("bigint"))


def lower_text(c: str | Column) -> Column:
    """Null-safe lower-case text (NULL -> '')."""
    return F.lower(F.coalesce(col_(c).cast("string"), F.lit("")))


def upper_trim(c: str | Column) -> Column:
    """Null-safe trimmed upper-case text (NULL -> '')."""
    return F.upper(F.trim(F.coalesce(col_(c).cast("string"), F.lit(""))))


def pct_to_fraction(c: str | Column) -> Column:
    """``'87%'`` -> 0.87; unparsable or missing -> NULL."""
    txt = F.replace(F.trim(col_(c).cast("string")), F.lit("%"), F.lit(""))
    v = to_double(F.trim(txt))
    return v / F.lit(100.0)


def clean_column_name(name: str) -> str:
    """Leaderboard header clean-up: lower case, non-word runs -> '_', trimmed."""
    import re

    s = re.sub(r"\W+", "_", name.strip().lower())
    return s.strip("_")


def find_column(df_or_cols: DataFrame | Sequence[str], *aliases: str) -> str | None:
    """Case-insensitive column lookup with ordered aliases (first alias found wins)."""
    cols = df_or_cols.columns if isinstance(df_or_cols, DataFrame) else list(df_or_cols)
    lower = {c.lower(): c for c in cols}
    for a in aliases:
        if a.lower() in lower:
            return lower[a.lower()]
    return None


def normalize_bronze(df: DataFrame, id_columns: Iterable[str] = ("pitcher", "batter")) -> DataFrame:
    """Rename ``date`` -> ``game_date`` when needed, coerce ids, derive ``year``.

    Float columns get NaN -> NULL so that later aggregates never see NaN.
    """
    out = df
    if "game_date" not in out.columns and "date" in out.columns:
        out = out.withColumnRenamed("date", "game_date")
    for c in id_columns:
        if c in out.columns:
            out = out.withColumn(c, to_long_id(c))
    for f in out.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out.withColumn(f.name, to_double(f.name))
    if "game_date" in out.columns and "year" not in out.columns:
        out = out.withColumn("year", F.year(F.col("game_date").cast("date")))
    return out


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")


def optional_double(df: DataFrame, name: str) -> Column:
    """Column if present, else a typed NULL (statistic becomes missing)."""
    if name in df.columns:
        return F.col(name).cast("double")
    return F.lit(None).cast("double")


def display_name(last: str | Column, first: str | Column) -> Column:
    """``Last, First``; one-sided fallback; NULL when both are blank."""
    ln = F.nullif(F.trim(col_(last)), F.lit(""))
    fn = F.nullif(F.trim(col_(first)), F.lit(""))
    return F.nullif(F.concat_ws(", ", ln, fn), F.lit(""))
