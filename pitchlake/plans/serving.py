"""Serving queries over the assignments and neighbour tables (Q3-Q7, T-1..T-4, P28, J8).

The tables are small per season; each function is one lazy DataFrame plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Display names of the six canonical clusters per role (cluster_id 0..5).
BATTER_LABELS = (
    "The Power Slugger",
    "The Backstop",
    "The Soft-Tossing Utility",
    "The Contact Hitter",
    "The Elite Glove/Speedster",
    "The Cannon Arm/Free-Swinger",
)
PITCHER_LABELS = (
    "The Finesse Artist",
    "The Power Starter",
    "The Flyballer",
    "The Deception Specialist",
    "The Groundball Specialist",
    "The High-Leverage Power Reliever",
)

REQUIRED = ("player_id", "player_name", "cluster_id", "role")


def label_table(spark: SparkSession) -> DataFrame:
    rows = [("batter", i, n) for i, n in enumerate(BATTER_LABELS)] + [("pitcher", i, n) for i, n in enumerate(PITCHER_LABELS)]
    return spark.createDataFrame(rows, "_role string, _cid long, label string")


def with_cluster_label(df: DataFrame, role_col: str = "role", cluster_col: str = "cluster_id", out: str = "label") -> DataFrame:
    """Label by (role, id), role case-insensitive; fallback ``Cluster <id>``.
    The label table has 12 rows, so the join is a broadcast of a fixed-size table."""
    labels = F.broadcast(label_table(df.sparkSession))
    j = df.join(labels, (F.lower(F.trim(F.col(role_col))) == F.col("_role")) & (F.col(cluster_col).cast("long") == F.col("_cid")), "left")
    fallback = F.concat(F.lit("Cluster "), F.col(cluster_col).cast("long").cast("string"))
    j = j.withColumn("_label", F.coalesce(F.col("label"), fallback)).drop("_role", "_cid", "label")
    return j.withColumnRenamed("_label", out)


def _check(df: DataFrame, need=REQUIRED) -> None:
    missing = sorted(set(need) - set(df.columns))
    if missing:
        raise ValueError(f"archetypes frame missing columns: {missing}")


def clusters_payload(archetypes: DataFrame) -> DataFrame:
    """Q3: one row per (year, role, cluster_id): label and the name-sorted player list.

    The nested list is the API payload, so it holds at most one season's roster of
    a role; the long form, without any list, is ``with_cluster_label``. A table
    without ``year`` is one season."""
    _check(archetypes)
    by = [*(["year"] if "year" in archetypes.columns else []), "role", "cluster_id"]
    grouped = archetypes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_players"),
        F.array_sort(F.collect_list(F.struct(
            F.col("player_name").cast("string").alias("player_name"), F.col("player_id").cast("long").alias("player_id")))).alias("_p"),
    )
    out = grouped.withColumn("players", F.transform("_p", lambda s: F.struct(s["player_id"].alias("player_id"), s["player_name"].alias("player_name"))))
    return with_cluster_label(out.drop("_p")).select(*by, "label", "n_players", "players").orderBy(*by)


def search_players(archetypes: DataFrame, q: str, limit: int = 50, *, regex: bool = False) -> DataFrame:
    """Q4: case-insensitive name match (literal by default; ``regex=True`` for a
    pattern), sorted by name, first ``limit``. Blank query -> empty result."""
    _check(archetypes)
    qn = (q or "").strip().lower()
    name = F.lower(F.col("player_name"))
    if not qn:
        cond = F.lit(False)
    elif regex:
        cond = name.rlike(qn)
    else:
        cond = F.contains(name, F.lit(qn))
    cols = ["player_id", "player_name", "role"] + (["year"] if "year" in archetypes.columns else []) + ["cluster_id"]
    hits = archetypes.where(F.coalesce(cond, F.lit(False))).select(*cols)
    hits = with_cluster_label(hits, out="cluster_label")
    return hits.orderBy("player_name", "player_id").limit(int(limit))


def neighbors_for_player(neighbors: DataFrame, *, player_id: int, role: str) -> DataFrame:
    """Q5: neighbour list of one player in one role, by rank."""
    need = {"neighbor_rank", "neighbor_player_id", "neighbor_player_name", "distance"}
    if not need.issubset(neighbors.columns):
        raise ValueError("neighbors frame missing expected columns")
    return (
        neighbors.where((F.col("player_id") == F.lit(player_id)) & (F.lower(F.col("role")) == F.lit(role.strip().lower())))
        .select(F.col("neighbor_rank").alias("rank"), F.col("neighbor_player_id").alias("player_id"),
                F.col("neighbor_player_name").alias("player_name"), "distance")
        .orderBy("rank")
    )


def player_name_lookup(archetypes: DataFrame, *, player_id: int, role: str) -> str | None:
    """First matching name, else None (one row read)."""
    row = archetypes.where((F.col("player_id") == F.lit(player_id)) & (F.lower(F.col("role")) == F.lit(role.lower()))).select(
        "player_name").first()
    return None if row is None else str(row[0])


def player_leaderboard(archetypes: DataFrame, role: str, limit: int = 500) -> DataFrame:
    """Q6: distinct players of a role (first row per id), sorted by name, first ``limit``."""
    if limit < 1:
        raise ValueError(f"limit must be 1 or more; got {limit}")
    sub = archetypes.where(F.lower(F.col("role")) == F.lit(role.strip().lower()))
    order = F.struct(*[F.col(c) for c in ("year", "cluster_id", "player_name") if c in sub.columns])
    first = sub.groupBy("player_id").agg(F.min_by("player_name", order).alias("player_name"))
    return first.select("player_id", "player_name").orderBy("player_name", "player_id").limit(limit)


def snapshot_summary(archetypes: DataFrame, neighbors: DataFrame, *, year: int | None, source: str) -> DataFrame:
    """Q7: row counts of the two tables plus year and provenance, as one row."""
    a = archetypes.select(F.lit(1).alias("_a"), F.lit(0).alias("_n"))
    n = neighbors.select(F.lit(0).alias("_a"), F.lit(1).alias("_n"))
    return a.unionByName(n).agg(
        F.lit(year).cast("int").alias("year"), F.lit(source).alias("source"),
        F.sum("_a").cast("bigint").alias("n_archetype_rows"), F.sum("_n").cast("bigint").alias("n_neighbor_rows"))
