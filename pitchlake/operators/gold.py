"""Silver -> gold preprocessing.

All cohorts (role, year) are handled by the same few distributed jobs:

1. pairwise Pearson r (A29) from moment matrices reduced on executors (NumPy
   partials; constant columns give NULL instead of raising), of which only pairs
   at the threshold leave the executors;
2. distinct counts (A28), of which only columns near zero variance do.

What becomes of every column is a list of decisions: (cohort, rule, column, kept
column, r). The rules are data: patterns of names, and an order of preference
that is a sort key. The gold columns of a cohort are the ones without a decision.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identity columns, never features.
ID_COLUMNS = ("player_id", "year", "role", "player_name")

# Pitch-type share codes dropped from training features.
EXCLUDED_SHARE_CODES = (
    "UN", "NONE", "PO", "EP", "FA", "CS", "SC", "FO", "KN", "CH",
    "CU", "FC", "FF", "FS", "KC", "SI", "SL", "ST", "SV",
)

# Names that are not trained on (P26) and names preferred of a correlated pair (M2).
UNTRAINED = re.compile(
    r".*_was_missing|pt_.*|xwoba_allowed_[lr]hb_mean|pitch_type_(" + "|".join(EXCLUDED_SHARE_CODES) + ")_share"
)
PREFERRED = re.compile(r"estimated_|.*xwoba|.*_adj_estimated_")

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)

HARD, CORRELATED, NEAR_ZERO, NOT_TRAINED = "hard_drop", "correlation", "near_zero_variance", "archetype_training"


@dataclass(frozen=True)
class GoldConfig:
    correlation_threshold: float = 0.95
    hard_drop_columns: tuple[str, ...] = ("woba_value_mean",)
    near_zero_variance_unique_ratio: float = 0.005
    protect_columns: tuple[str, ...] = ()


class Decision(NamedTuple):
    """Why a column of a cohort goes; ``kept`` and ``r`` where another column stands for it."""

    cohort: tuple
    rule: str
    column: str
    kept: str | None = None
    r: float | None = None


class Gold(NamedTuple):
    """Outcome of :func:`preprocess_cohorts`; frames are lazy and by cohort, like the row counts."""

    frames: dict[tuple, DataFrame]
    sizes: dict[tuple, int]
    decisions: list[Decision]
    filled: list[str]

    def dropped(self, key: tuple, rule: str) -> list[str]:
        return sorted(d.column for d in self.decisions if d.cohort == key and d.rule == rule)


# ------------------------------------------------------------------ column rules


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ID_COLUMNS) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ID_COLUMNS) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ex]


def standing(protect: Iterable[str] = ()):
    """Sort key of columns: of two correlated ones the first stays (M2).

    Protected ones come first, then preferred ones, then smaller names."""
    held = frozenset(protect)
    return lambda column: (column not in held, not PREFERRED.match(column), column)


# ------------------------------------------------------------------ row transforms


def inf_to_null(df: DataFrame) -> DataFrame:
    """+-inf (and NaN) -> NULL on floating columns."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            cols.append(F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def fill_missing(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numerics -> 0.0, text -> 'unknown', ids untouched; returns the numeric columns filled."""
    nums = numeric_columns(df)
    strs = string_columns(df)
    out = df
    if nums:
        out = out.fillna(0.0, subset=nums) if all(
            isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in nums
        ) else out.select(*[
            F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in nums else F.col(c)
            for c in df.columns
        ])
    if strs:
        out = out.fillna("unknown", subset=strs)
    return out, sorted(nums)


def hard_drop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    dropped = [c for c in columns if c in df.columns]
    return df.drop(*dropped), sorted(dropped)


# ------------------------------------------------------------------ distributed statistics


def correlation_long(df: DataFrame, cohort: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(cohort..., col_a, col_b, r) for every pair a < b (column order).

    Values are standardised per cohort first (one aggregate of means and
    population stds, joined back on the cohort key), then pair-complete moment
    matrices are reduced on executors (``moments.pairwise_moments``). r is the
    exact pair-complete Pearson coefficient; NULL when a column is constant in
    the cohort (ANSI ``corr`` would raise on those)."""
    from .moments import pairwise_moments, pearson_from_moments

    cols = list(cols)
    ck = list(cohort)
    if len(cols) < 2:
        schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in ck] + ["col_a string", "col_b string", "r double"])
        return df.sparkSession.createDataFrame([], schema)
    from ..session import cut_lineage
    from .moments import column_moments

    # three passes: the frame's plan runs once
    vec = cut_lineage(df.select(*ck, F.array(*[F.col(c).cast("double") for c in cols]).alias("_z")))
    mom = column_moments(vec, "_z", len(cols), ck)
    std = {}
    for key, m in mom.items():
        sd = m["std"]
        std[key] = (np.nan_to_num(m["mean"]), np.where((sd > 0) & np.isfinite(sd), sd, 1.0))
    m = pearson_from_moments(pairwise_moments(vec, "_z", len(cols), ck, std))
    names = F.array(*[F.lit(c) for c in cols])
    return m.select(*ck, F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"), "r")


def distinct_stats(df: DataFrame, cohort: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per cohort and column, row count and distinct values counting missing as one value."""
    if not cols:
        return df.groupBy(*cohort).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("column", F.lit(None).cast("string")).withColumn("n_distinct", F.lit(None).cast("long"))
    long = df.select(*cohort, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("_e")).select(*cohort, "_e.column", "_e.v")
    per = long.groupBy(*cohort, "column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("n_distinct"),
    )
    return per


def correlated_losers(pairs: Iterable[tuple[str, str, float]], protect: Iterable[str] = ()) -> list[tuple[str, str, float]]:
    """M1: (lost, kept, |r|) of correlated pairs taken in the order given.

    A pair is passed over when one of its columns is lost already, or both are protected."""
    held, rank = frozenset(protect), standing(protect)
    lost: dict[str, tuple[str, float]] = {}
    for a, b, r in pairs:
        first, second = sorted((a, b), key=rank)
        if second not in held and lost.keys().isdisjoint((a, b)):
            lost[second] = (first, abs(r))
    return [(column, kept, r) for column, (kept, r) in lost.items()]


# ------------------------------------------------------------------ the chain


def prepare(df: DataFrame, config: GoldConfig) -> tuple[DataFrame, list[str], list[str]]:
    """P23 -> P24 -> P25 (row-level, lazy)."""
    out = inf_to_null(df)
    out, filled = fill_missing(out)
    out, hard = hard_drop(out, config.hard_drop_columns)
    return out, filled, hard


def _by_cohort(rows, cohort: Sequence[str]) -> dict[tuple, list]:
    out: dict[tuple, list] = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in cohort), []).append(r)
    return out


def _kept_by_cohort(df: DataFrame, cohort: Sequence[str]) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, partitioned by cohort: the silver plan
    runs once, and reading one cohort reads its own files only."""
    import uuid

    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gold-{uuid.uuid4().hex}"
    df.write.partitionBy(*cohort).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def preprocess_cohorts(silver: DataFrame, config: GoldConfig = GoldConfig(), cohort: Sequence[str] = ("role", "year")) -> Gold:
    """M4 for every cohort at once."""
    base, filled, hard = prepare(silver, config)
    columns = [c for c in numeric_columns(base) if c not in cohort]
    place = {c: i for i, c in enumerate(columns)}
    base = _kept_by_cohort(base, cohort)
    sizes = {tuple(r[c] for c in cohort): r["count"] for r in base.groupBy(*cohort).count().collect()}
    near = correlation_long(base, cohort, columns).where(F.abs("r") >= config.correlation_threshold)
    pairs = _by_cohort(near.collect(), cohort)
    ratio = F.col("n_distinct") / F.col("n_rows")
    flat = distinct_stats(base, cohort, columns).where((F.col("n_distinct") <= 1) | (ratio <= config.near_zero_variance_unique_ratio))
    flat_columns = _by_cohort(flat.where(F.col("column").isNotNull()).collect(), cohort)
    decisions: list[Decision] = []
    frames: dict[tuple, DataFrame] = {}
    for key in sorted(sizes):
        ordered = sorted(pairs.get(key, ()), key=lambda r: (place[r["col_a"]], place[r["col_b"]]))
        own = [Decision(key, HARD, c) for c in hard]
        own += [Decision(key, CORRELATED, *x) for x in correlated_losers(((r["col_a"], r["col_b"], r["r"]) for r in ordered), config.protect_columns)]
        gone = {d.column for d in own}
        own += [Decision(key, NEAR_ZERO, r["column"]) for r in flat_columns.get(key, ()) if r["column"] not in gone.union(config.protect_columns)]
        gone = {d.column for d in own}
        own += [Decision(key, NOT_TRAINED, c) for c in base.columns if c not in gone and UNTRAINED.fullmatch(c)]
        gone = {d.column for d in own}
        only = [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(cohort, key)]
        frame = base
        for condition in only:
            frame = frame.where(condition)
        frames[key] = frame.select(*[c for c in base.columns if c not in gone])
        decisions += own
    return Gold(frames, sizes, decisions, filled)


def cohort_metadata(gold: Gold, key: tuple, config: GoldConfig, cohort: Sequence[str] = ("role", "year")) -> dict:
    """The cohort's JSON document. Its key names are a fixed contract."""
    named, columns = dict(zip(cohort, key)), gold.frames[key].columns
    by_rule = {rule: gold.dropped(key, rule) for rule in (HARD, CORRELATED, NEAR_ZERO, NOT_TRAINED)}
    pairs = [d for d in gold.decisions if d.cohort == key and d.rule == CORRELATED]
    return {
        "role": named.get("role", ""),
        "year": int(named.get("year", 0)),
        "row_count": gold.sizes[key],
        "id_columns": [c for c in ID_COLUMNS if c in columns],
        "feature_columns": sorted(set(columns) - set(ID_COLUMNS)),
        "numeric_columns_filled_zero": gold.filled,
        "hard_dropped_columns": by_rule[HARD],
        "correlation_dropped_columns": [{"dropped": d.column, "kept": d.kept, "correlation": f"{d.r:.6f}"} for d in pairs],
        "near_zero_variance_dropped_columns": by_rule[NEAR_ZERO],
        "archetype_training_dropped_columns": by_rule[NOT_TRAINED],
        "dropped_columns": {
            rule if rule == HARD else f"{rule}_drop": names for rule, names in by_rule.items()
        },
        "correlation_threshold": float(config.correlation_threshold),
    }


def missing_value_report(df: DataFrame, cols: Sequence[str] | None = None, *, with_count: bool = False):
    """One aggregate counting NULL/NaN per numeric column; only non-zero entries
    returned. ``with_count`` also returns the row count from the same job."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = [F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("long")).alias(c) for c in cols]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    report = {c: int(row[c] or 0) for c in cols if row[c]}
    return (report, int(row["_rows"])) if with_count else report


def missing_by_cohort(frames: dict[tuple, DataFrame]) -> dict[tuple, dict[str, int]]:
    """P30 for many cohorts in one job: {cohort: {numeric column: rows without a value}}, only where there are any."""
    keys, every = list(frames), None
    for i, key in enumerate(keys):
        cols = [c for c in numeric_columns(frames[key]) if c not in ("role", "year")]
        counts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("n")) for c in cols]
        if counts:
            one = frames[key].agg(F.filter(F.array(*counts), lambda x: x["n"] > 0).alias("bad")).select(F.lit(i).alias("at"), F.inline("bad"))
            every = one if every is None else every.unionByName(one)
    out: dict[tuple, dict[str, int]] = {}
    for r in every.collect() if every is not None else ():
        out.setdefault(keys[r["at"]], {})[r["column"]] = r["n"]
    return out


def assert_no_missing(df: DataFrame, cols: Sequence[str] | None = None, what: str = "gold features") -> None:
    bad = missing_value_report(df, cols)
    if bad:
        raise ValueError(f"NaN values remain in numeric {what}: {sorted(bad)}")
