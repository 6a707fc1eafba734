"""Silver -> gold job (M5): all (role, year) cohorts preprocessed, written, and
their artifacts recorded as JSON metadata next to the data."""

from __future__ import annotations


from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import gold as gd
from ..operators.pitch_types import widen_maps
from ..sources import lake

ROLE_FILTERS = ("batter", "pitcher", "all")


def roles_for(role_filter: str) -> tuple[str, ...]:
    if role_filter not in ROLE_FILTERS:
        raise ValueError(f"role must be one of {ROLE_FILTERS}; got {role_filter!r}")
    return ("batter", "pitcher") if role_filter == "all" else (role_filter,)


def build_silver_to_gold(
    spark: SparkSession,
    *,
    silver_root: str,
    gold_root: str,
    metadata_root: str,
    start_year: int,
    end_year: int,
    role_filter: str = "all",
    config: gd.GoldConfig = gd.GoldConfig(),
) -> dict:
    """Cohorts come from the partition listing (pruned by role and year)."""
    try:
        roles = roles_for(role_filter)
    except ValueError as exc:
        return {"status": "error", "message": str(exc), "rows_written": 0, "role_years_processed": []}
    if start_year > end_year:
        return {"status": "error", "message": f"years {start_year} .. {end_year} are out of order", "rows_written": 0, "role_years_processed": []}
    done, documents = [], []
    for role in roles:
        silver = lake.read_role(spark, silver_root, role)
        if silver is None:
            continue
        silver = silver.where(F.col("year").between(start_year, end_year))
        if silver.isEmpty():
            continue
        # per-type map columns -> pitch_type_<PT>_share / pt_<PT>_* columns (small table)
        silver = widen_maps(silver)
        gold = gd.preprocess_cohorts(silver, config)
        if bad := gd.missing_by_cohort(gold.frames):
            raise ValueError("NaN values remain in numeric gold features: " + "; ".join(f"{key}: {sorted(cols)}" for key, cols in sorted(bad.items())))
        for key, frame in gold.frames.items():
            lake.write_partitioned(frame, gold_root, ("role", "year"))
            done.append({"role": key[0], "year": int(key[1]), "rows": gold.sizes[key]})
            documents.append(gd.cohort_metadata(gold, key, config))
    if not done:
        return {"status": "no_data", "message": "no silver rows in range", "rows_written": 0, "role_years_processed": []}
    rows_written = sum(d["rows"] for d in done)
    lake.write_metadata(spark, metadata_root, documents)
    return {"status": "ok", "message": f"gold: {len(done)} cohorts, {rows_written} rows", "rows_written": rows_written,
            "role_years_processed": done}


