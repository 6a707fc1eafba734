"""Pitch-type profile (A17-A19): shares, entropy and per-type physical means.

The canonical form is *long* (one row per player-year and type), because the
set of types is data dependent. ``widen`` pivots on demand into the
``pitch_type_<PT>_share`` / ``pt_<PT>_<measure>_mean`` columns; the list of
codes is a tiny distinct-set (bounded by the code vocabulary), never the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags as fl

PHYSICAL_MEASURES = ("release_speed", "release_spin_rate", "pfx_x")


def pitch_type_counts(df: DataFrame, id_col: str, type_col: str = "pitch_type") -> DataFrame:
    """(id, year, pitch_type, n) over raw non-null types (no trim / upper, junk kept)."""
    return (
        df.where(F.col(type_col).isNotNull())
        .groupBy(id_col, "year", F.col(type_col).alias("pitch_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pitch_type_shares(df: DataFrame, id_col: str, type_col: str = "pitch_type") -> DataFrame:
    """A18 long form: (id, year, pitch_type, n, share)."""
    counts = pitch_type_counts(df, id_col, type_col)
    w = Window.partitionBy(id_col, "year")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


def entropy_from_shares(shares: DataFrame, keys: Sequence[str], share_col: str = "share") -> DataFrame:
    """Shannon entropy (natural log) per key; exactly 0.0 for a single category."""
    p = F.col(share_col)
    ent = F.when(F.count(F.lit(1)) > 1, -F.sum(p * F.ln(p))).otherwise(F.lit(0.0))
    return shares.where(p > 0).groupBy(*keys).agg(ent.alias("entropy"))


def pitch_type_entropy(df: DataFrame, id_col: str, type_col: str = "pitch_type") -> DataFrame:
    """(id, year, pitch_type_entropy); player-years without any typed pitch get no row."""
    sh = pitch_type_shares(df, id_col, type_col)
    return entropy_from_shares(sh, (id_col, "year")).withColumnRenamed("entropy", "pitch_type_entropy")


def category_entropy(df: DataFrame, keys: Sequence[str], category_col: str) -> DataFrame:
    """Generic A18+A19 for any categorical column: entropy of its distribution per key."""
    counts = df.where(F.col(category_col).isNotNull()).groupBy(*keys, category_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    sh = counts.withColumn("share", F.col("n") / F.sum("n").over(w))
    return entropy_from_shares(sh, keys)


def pitch_type_physical(
    df: DataFrame, id_col: str, *, min_pitches_per_type: int, type_col: str = "pitch_type"
) -> DataFrame:
    """A17 long form: per cleaned type with >= ``min_pitches_per_type`` pitches, the
    mean release speed, spin rate and horizontal break."""
    pt = fl.pitch_type_clean(type_col)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(m).alias(f"{m}_mean") for m in PHYSICAL_MEASURES]
    return (
        df.withColumn("_pt", pt)
        .where(F.col("_pt").isNotNull())
        .groupBy(id_col, "year", F.col("_pt").alias("pitch_type"))
        .agg(*aggs)
        .where(F.col("n") >= min_pitches_per_type)
    )


def distinct_codes(long_df: DataFrame) -> list[str]:
    """The (tiny) vocabulary of pitch-type codes present, sorted."""
    return sorted(r[0] for r in long_df.select("pitch_type").distinct().collect())


def widen(
    shares: DataFrame,
    physical: DataFrame,
    entropy: DataFrame,
    id_col: str,
    *,
    share_codes: Sequence[str] | None = None,
    physical_codes: Sequence[str] | None = None,
) -> DataFrame:
    """Pivot the long tables into one row per player-year."""
    share_codes = list(share_codes) if share_codes is not None else distinct_codes(shares)
    physical_codes = list(physical_codes) if physical_codes is not None else distinct_codes(physical)
    keys = [id_col, "year"]
    sh = shares.groupBy(*keys).agg(
        *[F.max(F.when(F.col("pitch_type") == c, F.col("share"))).alias(f"pitch_type_{c}_share") for c in share_codes]
    ) if share_codes else None
    ph_exprs = []
    for c in physical_codes:
        for m in PHYSICAL_MEASURES:
            ph_exprs.append(F.max(F.when(F.col("pitch_type") == c, F.col(f"{m}_mean"))).alias(f"pt_{c}_{m}_mean"))
    ph = physical.groupBy(*keys).agg(*ph_exprs) if ph_exprs else None
    out = entropy
    if sh is not None:
        out = out.join(sh, keys, "full")
    if ph is not None:
        out = out.join(ph, keys, "full")
    return out


def type_summary(df: DataFrame, id_col: str, type_col: str = "pitch_type") -> DataFrame:
    """One pass over the pitches: per (id, year, raw type) the count and the sums /
    counts of the physical measures. Everything else in the profile is derived
    from this small table."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in PHYSICAL_MEASURES:
        aggs += [F.sum(m).alias(f"_s_{m}"), F.count(m).alias(f"_c_{m}")]
    return df.groupBy(id_col, "year", F.col(type_col).alias("pitch_type")).agg(*aggs)


def profile_from_summary(summary: DataFrame, id_col: str, *, min_pitches_per_type: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shares long, physical long, entropy) from ``type_summary``."""
    keys = [id_col, "year"]
    counts = summary.where(F.col("pitch_type").isNotNull()).select(*keys, "pitch_type", "n")
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    ent = entropy_from_shares(shares, keys).withColumnRenamed("entropy", "pitch_type_entropy")
    pt = fl.pitch_type_clean("pitch_type")
    aggs = [F.sum("n").alias("n")]
    for m in PHYSICAL_MEASURES:
        aggs.append((F.sum(f"_s_{m}") / F.sum(f"_c_{m}")).alias(f"{m}_mean"))
    phys = (
        summary.withColumn("_pt", pt).where(F.col("_pt").isNotNull())
        .groupBy(*keys, F.col("_pt").alias("pitch_type")).agg(*aggs)
        .where(F.col("n") >= min_pitches_per_type)
    )
    return shares, phys, ent


def type_vocabulary(df: DataFrame, type_col: str = "pitch_type") -> list[tuple[str, str | None]]:
    """(raw code, cleaned code or None) for every non-null raw type: one
    single-column distinct (column-pruned scan, partial aggregation). The
    result is the code vocabulary -- a handful of values, never data rows."""
    rows = (
        df.where(F.col(type_col).isNotNull())
        .select(F.col(type_col).alias("raw"), fl.pitch_type_clean(type_col).alias("clean"))
        .distinct()
        .collect()
    )
    return sorted((r["raw"], r["clean"]) for r in rows)


def type_code_aggregates(vocab: Sequence[tuple[str, str | None]], type_col: str = "pitch_type") -> list:
    """Conditional aggregates per raw code (counts) and per cleaned code (count and
    measure means), to be evaluated inside the player-year aggregate."""
    raw = F.col(type_col)
    clean = fl.pitch_type_clean(type_col)
    out = [F.count(F.when(raw == F.lit(r), 1)).alias(f"_ptn_{i}") for i, (r, _c) in enumerate(vocab)]
    for j, c in enumerate(sorted({c for _r, c in vocab if c is not None})):
        out.append(F.count(F.when(clean == F.lit(c), 1)).alias(f"_pcn_{j}"))
        for m in PHYSICAL_MEASURES:
            out.append(F.avg(F.when(clean == F.lit(c), F.col(m))).alias(f"_pcm_{j}_{m}"))
    return out


def maps_from_code_aggregates(df: DataFrame, vocab: Sequence[tuple[str, str | None]], *, min_pitches_per_type: int) -> DataFrame:
    """Turn the conditional aggregates into ``pitch_type_entropy``, ``pitch_type_shares``
    (map<type, share>) and ``pitch_type_means`` (map<type, struct<n, <measure>_mean...>>)."""
    raws = [r for r, _c in vocab]
    cleans = sorted({c for _r, c in vocab if c is not None})
    helper = [c for c in df.columns if c.startswith(("_ptn_", "_pcn_", "_pcm_"))]
    if not raws:
        nul = F.lit(None)
        return df.select(*[c for c in df.columns if c not in helper], nul.cast("double").alias("pitch_type_entropy"),
                         nul.cast("map<string,double>").alias("pitch_type_shares"),
                         nul.cast("map<string,struct<n:bigint,release_speed_mean:double,release_spin_rate_mean:double,pfx_x_mean:double>>")
                         .alias("pitch_type_means"))
    counts = F.array(*[F.struct(F.lit(r).alias("k"), F.col(f"_ptn_{i}").alias("n")) for i, r in enumerate(raws)])
    typed = F.filter(counts, lambda e: e["n"] > 0)
    total = F.aggregate(typed, F.lit(0).cast("long"), lambda a, e: a + e["n"])
    shares = F.transform(typed, lambda e: F.struct(e["k"].alias("k"), (e["n"] / total).alias("v")))
    ent_sum = F.aggregate(shares, F.lit(0.0), lambda a, e: a + e["v"] * F.ln(e["v"]))
    entropy = F.when(F.size(typed) > 1, -ent_sum).when(F.size(typed) == 1, F.lit(0.0))
    if cleans:
        stats = F.array(*[
            F.struct(F.lit(c).alias("k"), F.struct(
                F.col(f"_pcn_{j}").alias("n"), *[F.col(f"_pcm_{j}_{m}").alias(f"{m}_mean") for m in PHYSICAL_MEASURES]
            ).alias("v"))
            for j, c in enumerate(cleans)
        ])
        means = F.filter(stats, lambda e: e["v"]["n"] >= min_pitches_per_type)
        means_col = F.when(F.size(means) > 0, F.map_from_entries(means))
    else:
        means_col = F.lit(None).cast(
            "map<string,struct<n:bigint,release_speed_mean:double,release_spin_rate_mean:double,pfx_x_mean:double>>")
    return df.select(
        *[c for c in df.columns if c not in helper],
        entropy.alias("pitch_type_entropy"),
        F.when(F.size(typed) > 0, F.map_from_entries(shares)).alias("pitch_type_shares"),
        means_col.alias("pitch_type_means"),
    )


def widen_maps(silver: DataFrame, *, share_codes: Sequence[str] | None = None,
               physical_codes: Sequence[str] | None = None, drop_maps: bool = True) -> DataFrame:
    """Pivot the map columns of a silver table into ``pitch_type_<PT>_share`` and
    ``pt_<PT>_<measure>_mean`` columns. The code lists come from the map keys of
    the (small, one row per player-year) silver table when not given."""
    out = silver
    if "pitch_type_shares" in silver.columns:
        codes = share_codes if share_codes is not None else sorted(
            r[0] for r in silver.select(F.explode(F.map_keys("pitch_type_shares"))).distinct().collect())
        out = out.select("*", *[F.col("pitch_type_shares")[c].alias(f"pitch_type_{c}_share") for c in codes])
    if "pitch_type_means" in silver.columns:
        codes = physical_codes if physical_codes is not None else sorted(
            r[0] for r in silver.select(F.explode(F.map_keys("pitch_type_means"))).distinct().collect())
        out = out.select("*", *[F.col("pitch_type_means")[c][f"{m}_mean"].alias(f"pt_{c}_{m}_mean")
                                for c in codes for m in PHYSICAL_MEASURES])
    if drop_maps:
        out = out.drop(*[c for c in ("pitch_type_shares", "pitch_type_means") if c in out.columns])
    return out
