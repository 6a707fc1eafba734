"""Registered serving queries: ``customer`` as the assignments table (segment = cluster),
``embeddings`` KNN as the neighbour table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import knn as knn_ops
from . import serving as sv
from .queries_ml import K, _emb, _knn_sql
from .registry import finalize, register

ARCHETYPES_SQL = """
SELECT c_custkey AS player_id, c_name AS player_name,
  CASE WHEN c_nationkey % 2 = 0 THEN 'batter' ELSE 'Pitcher' END AS role, CAST(2024 AS INT) AS year,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3
       WHEN 'MACHINERY' THEN 7 END AS cluster_id
FROM {customer}
"""

_A = f"a AS ({fx.duck(ARCHETYPES_SQL).strip()})"
_LABELS = "l AS (SELECT * FROM (VALUES " + ", ".join(
    [f"('batter', {i}, '{n}')" for i, n in enumerate(sv.BATTER_LABELS)]
    + [f"('pitcher', {i}, '{n}')" for i, n in enumerate(sv.PITCHER_LABELS)]
) + ") t(r, cid, label))"
SEARCH_Q = "customer#0000001"
LOOKUP_ID = 7


def archetypes(spark, d):
    return spark.sql(ARCHETYPES_SQL, customer=fx.table(spark, d, "customer"))


def neighbours(spark, d, only_ids=None):
    nn = knn_ops.knn(_emb(spark, d), id_col="vec_id", vec_col="v", k=K, only_ids=only_ids)
    return nn.select(
        F.col("vec_id").alias("player_id"), F.lit("batter").alias("role"), "neighbor_rank",
        F.col("neighbor_id").alias("neighbor_player_id"),
        F.concat(F.lit("vec "), F.col("neighbor_id").cast("string")).alias("neighbor_player_name"), "distance")


register(
    "clusters_payload",
    f"""WITH {_A}, {_LABELS}
SELECT a.year, a.role, a.cluster_id, COALESCE(l.label, 'Cluster ' || CAST(a.cluster_id AS VARCHAR)) AS label, COUNT(*) AS n_players,
  CAST(to_json(list(struct_pack(player_id := a.player_id, player_name := a.player_name) ORDER BY a.player_name, a.player_id)) AS VARCHAR) AS players_json
FROM a LEFT JOIN l ON LOWER(TRIM(a.role)) = l.r AND a.cluster_id = l.cid GROUP BY a.year, a.role, a.cluster_id, l.label""",
)(lambda spark, d: sv.clusters_payload(archetypes(spark, d)).select(
    "year", "role", "cluster_id", "label", "n_players", F.to_json("players").alias("players_json")))

register(
    "cluster_labels",
    f"""WITH {_A}, {_LABELS}
SELECT a.player_id, a.role, a.cluster_id, COALESCE(l.label, 'Cluster ' || CAST(a.cluster_id AS VARCHAR)) AS label
FROM a LEFT JOIN l ON LOWER(TRIM(a.role)) = l.r AND a.cluster_id = l.cid""",
)(lambda spark, d: sv.with_cluster_label(archetypes(spark, d)).select("player_id", "role", "cluster_id", "label"))

register(
    "search_names",
    f"""WITH {_A}, {_LABELS}
SELECT a.player_id, a.player_name, a.role, a.year, a.cluster_id, COALESCE(l.label, 'Cluster ' || CAST(a.cluster_id AS VARCHAR)) AS cluster_label
FROM a LEFT JOIN l ON LOWER(TRIM(a.role)) = l.r AND a.cluster_id = l.cid
WHERE contains(LOWER(a.player_name), '{SEARCH_Q}') ORDER BY a.player_name, a.player_id LIMIT 50""",
)(lambda spark, d: sv.search_players(archetypes(spark, d), SEARCH_Q.upper(), 50))

register(
    "leaderboard",
    f"""WITH {_A}
SELECT player_id, arg_min(player_name, struct_pack(y := year, c := cluster_id, n := player_name)) AS player_name
FROM a WHERE LOWER(role) = 'pitcher' GROUP BY player_id ORDER BY player_name, player_id LIMIT 500""",
)(lambda spark, d: sv.player_leaderboard(archetypes(spark, d), "pitcher", 500))

register(
    "neighbors_lookup",
    f"""WITH q AS ({_knn_sql('list_distance(a.v, b.v)')})
SELECT neighbor_rank AS rank, neighbor_id AS player_id, 'vec ' || CAST(neighbor_id AS VARCHAR) AS player_name, distance
FROM q WHERE vec_id = {LOOKUP_ID}""",
)(lambda spark, d: finalize(
    sv.neighbors_for_player(neighbours(spark, d, [LOOKUP_ID]), player_id=LOOKUP_ID, role="Batter")
    .withColumn("rank", F.col("rank").cast("bigint")), 9))

register(
    "snapshot_summary",
    f"""SELECT CAST(2024 AS INT) AS year, 'lake' AS source, (SELECT COUNT(*) FROM customer) AS n_archetype_rows,
  (SELECT COUNT(*) * {K} FROM embeddings) AS n_neighbor_rows""",
)(lambda spark, d: sv.snapshot_summary(archetypes(spark, d), neighbours(spark, d), year=2024, source="lake"))
