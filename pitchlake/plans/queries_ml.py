"""Registered model-side queries over ``embeddings`` (label = cluster id) and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import knn as knn_ops
from ..operators import metrics as mt
from ..operators import scaling as sc
from .registry import finalize, register

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
K = 10
EMB_DIM_PREFIX = "f"


def _emb(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _knn_sql(dist: str) -> str:
    return f"""WITH {_E},
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, {dist} AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS neighbor_rank FROM p)
SELECT vec_id, neighbor_rank, neighbor_id, ROUND(distance, 9) AS distance FROM r WHERE neighbor_rank <= {K}"""


def _knn_query(metric: str, p: float = 2.0):
    def run(spark, d):
        out = knn_ops.knn(_emb(spark, d), id_col="vec_id", vec_col="v", k=K, metric=metric, p=p)
        return finalize(out.select("vec_id", F.col("neighbor_rank").cast("bigint").alias("neighbor_rank"), "neighbor_id", "distance"), 9)

    return run


_ZIP = "list_zip(a.v, b.v)"
register("knn_euclidean", _knn_sql("list_distance(a.v, b.v)"))(_knn_query("euclidean"))
register("knn_manhattan", _knn_sql(f"list_sum(list_transform({_ZIP}, lambda x: abs(x[1] - x[2])))"))(_knn_query("manhattan"))
register("knn_chebyshev", _knn_sql(f"list_max(list_transform({_ZIP}, lambda x: abs(x[1] - x[2])))"))(_knn_query("chebyshev"))
register(
    "knn_minkowski3",
    _knn_sql(f"pow(list_sum(list_transform({_ZIP}, lambda x: pow(abs(x[1] - x[2]), 3))), 1.0 / 3)"),
)(_knn_query("minkowski", 3.0))

# M12 ------------------------------------------------------------------------------
register(
    "davies_bouldin",
    f"""WITH {_E},
u AS (SELECT vec_id, label, UNNEST(range(len(v))) AS i, UNNEST(v) AS x FROM e),
c AS (SELECT label, i, AVG(x) AS m FROM u GROUP BY label, i),
cl AS (SELECT label, list(m ORDER BY i) AS cv FROM c GROUP BY label),
s AS (SELECT e.label, AVG(list_distance(e.v, cl.cv)) AS sc FROM e JOIN cl ON e.label = cl.label GROUP BY e.label),
p AS (SELECT a.label, MAX(CASE WHEN list_distance(ca.cv, cb.cv) > 0 THEN (a.sc + b.sc) / list_distance(ca.cv, cb.cv) ELSE 0 END) AS r
      FROM s a JOIN s b ON a.label <> b.label JOIN cl ca ON ca.label = a.label JOIN cl cb ON cb.label = b.label GROUP BY a.label)
SELECT ROUND(AVG(r), 10) AS davies_bouldin, COUNT(*) AS n_clusters FROM p""",
)(lambda spark, d: finalize(
    mt.davies_bouldin(_emb(spark, d), "v", "label").select("davies_bouldin", F.col("n_clusters").cast("bigint"))
))

# M11 ------------------------------------------------------------------------------
register(
    "silhouette_euclidean",
    f"""WITH {_E},
d AS (SELECT a.vec_id AS x, a.label AS lx, b.label AS ly, AVG(list_distance(a.v, b.v)) AS md
      FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
r AS (SELECT x, MAX(CASE WHEN ly = lx THEN md END) AS a, MIN(CASE WHEN ly <> lx THEN md END) AS b FROM d GROUP BY x),
s AS (SELECT CASE WHEN a IS NULL THEN 0E0 ELSE (b - a) / GREATEST(a, b) END AS s FROM r)
SELECT ROUND(AVG(s), 10) AS silhouette, (SELECT COUNT(*) FROM e) AS n_rows, (SELECT COUNT(DISTINCT label) FROM e) AS n_clusters FROM s""",
)(lambda spark, d: finalize(mt.silhouette(_emb(spark, d), id_col="vec_id", vec_col="v", label_col="label")))

# A30 ------------------------------------------------------------------------------
register(
    "cluster_profiles",
    f"""WITH {_E},
u AS (SELECT label, UNNEST(range(len(v))) AS i, UNNEST(v) AS x FROM e),
n AS (SELECT label, COUNT(*) AS n FROM e GROUP BY label)
SELECT u.label, n.n, '{EMB_DIM_PREFIX}' || CAST(u.i AS VARCHAR) AS feature, ROUND(AVG(u.x), 10) AS mean
FROM u JOIN n ON u.label = n.label GROUP BY u.label, n.n, u.i""",
)(lambda spark, d: finalize(_profiles(spark, d)))


def _profiles(spark, d):
    e = _emb(spark, d)
    width = len(e.select("v").first()["v"])
    wide = sc.array_to_columns(e, "v", EMB_DIM_PREFIX, width)
    return mt.cluster_profiles(wide, [f"{EMB_DIM_PREFIX}{i}" for i in range(width)], "label")


# M6 -------------------------------------------------------------------------------
register(
    "standardize_population",
    """SELECT p_partkey, p_brand,
  ROUND((p_size - AVG(p_size) OVER w) / CASE WHEN STDDEV_POP(p_size) OVER w > 0 THEN STDDEV_POP(p_size) OVER w ELSE 1 END, 10) AS z_p_size,
  ROUND((p_retailprice - AVG(p_retailprice) OVER w) / CASE WHEN STDDEV_POP(p_retailprice) OVER w > 0 THEN STDDEV_POP(p_retailprice) OVER w ELSE 1 END, 10) AS z_p_retailprice
FROM part WINDOW w AS (PARTITION BY p_brand)""",
)(lambda spark, d: finalize(
    sc.standardize_population(fx.table(spark, d, "part"), ["p_size", "p_retailprice"], cohort=["p_brand"])
    .select("p_partkey", "p_brand", "z_p_size", "z_p_retailprice")
))


# M7 / M8 / M15 (rows only: eigen-decomposition has no SQL twin) ------------------------
def _emb_features(spark, d):
    e = _emb(spark, d)
    width = len(e.select("v").first()["v"])
    return sc.array_to_columns(e, "v", EMB_DIM_PREFIX, width), [f"{EMB_DIM_PREFIX}{i}" for i in range(width)]


register("pca_explained_variance")(lambda spark, d: _pca_variance(spark, d))
register("pca_cumulative_variance")(lambda spark, d: _pca_variance(spark, d, by_label=True))


def _pca_variance(spark, d, by_label=False):
    wide, cols = _emb_features(spark, d)
    cohort = ["label"] if by_label else []
    model = sc.fit_pca(wide, cols, 10, cohort)
    return finalize(sc.explained_variance_table(spark, model))


register("project_saved_model")(lambda spark, d: _project_saved(spark, d))


def _project_saved(spark, d):
    import uuid

    from ..session import ensure_checkpoint_dir

    wide, cols = _emb_features(spark, d)
    model = sc.fit_pca(wide, cols, 8, ["label"])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/pca-{uuid.uuid4().hex}"
    model.save(spark, path)
    loaded = sc.PcaModel.load(spark, path)
    return sc.transform(wide, loaded, "pca").select("vec_id", "label", "pca")


# KNN inside cohorts: the cohort key is part of the block join ---------------------------
register(
    "knn_cohort",
    f"""WITH {_E},
p AS (SELECT a.label, a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label, vec_id ORDER BY distance, neighbor_id) AS neighbor_rank FROM p)
SELECT label, vec_id, neighbor_rank, neighbor_id, ROUND(distance, 9) AS distance FROM r WHERE neighbor_rank <= 5""",
)(lambda spark, d: finalize(
    knn_ops.knn(_emb(spark, d), id_col="vec_id", vec_col="v", k=5, cohort=["label"])
    .select("label", "vec_id", F.col("neighbor_rank").cast("bigint").alias("neighbor_rank"), "neighbor_id", "distance"), 9))


# KNN through metric cells: more rows than a cell holds, whole coordinates (ties are exact and go by id) -----------------
register(
    "knn_cells",
    """WITH e AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(FLOOR(p_retailprice / 10) AS DOUBLE) AS y FROM part),
p AS (SELECT a.p_partkey, b.p_partkey AS neighbor_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance
      FROM e a JOIN e b ON a.p_partkey <> b.p_partkey),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY distance, neighbor_id) AS neighbor_rank FROM p)
SELECT p_partkey, neighbor_rank, neighbor_id, ROUND(distance, 9) AS distance FROM r WHERE neighbor_rank <= 5""",
)(lambda spark, d: _knn_cells(spark, d))


def _knn_cells(spark, d):
    place = F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 10).cast("double"))
    rows = fx.table(spark, d, "part").select("p_partkey", place.alias("v"))
    got = knn_ops.knn(rows, id_col="p_partkey", vec_col="v", k=5, metric="euclidean", candidate_block=512, query_block=256)
    return finalize(got.withColumn("neighbor_rank", F.col("neighbor_rank").cast("bigint")), 9)


# M9 / M10 / M13 / M16-M19 / T-5 (rows only; checked against NumPy in the unit tests) -----
def _emb_pca(spark, d, n_components=8):
    wide, cols = _emb_features(spark, d)
    model = sc.fit_pca(wide, cols, n_components)
    return sc.transform(wide, model, "z").select("vec_id", "label", "z")


register("gmm_assignments")(lambda spark, d: _gmm_assign(spark, d))


def _gmm_assign(spark, d):
    from ..operators import mixture as mx

    z = _emb_pca(spark, d)
    models = mx.fit_mixture(z, "z", 10, covariance_type="full", n_init=2, seed=42)
    return mx.predict(z, "z", models).select("vec_id", "label", "cluster_id")


def _grid(spark, d, method):
    from ..operators import tuning as tn

    wide, cols = _emb_features(spark, d)
    return tn.grid_sweep(spark, wide, id_col="vec_id", feature_cols=cols, pca_sizes=[4, 8], k_min=2, k_max=5,
                         method=method, seed=42, n_init=1)


register("kmeans_sweep")(lambda spark, d: _grid(spark, d, "kmeans"))
register("gmm_sweep")(lambda spark, d: _grid(spark, d, "gmm"))


def _best_bic(spark, d):
    from ..operators import tuning as tn

    return tn.best_row(_grid(spark, d, "gmm"), "gmm_bic", ascending=True)


register("best_by_bic")(_best_bic)


# Full model chain on the pitch domain ---------------------------------------------------
def _pitcher_gold(spark, d):
    from ..operators import gold as gd
    from .queries_gold import pitcher_silver

    return gd.preprocess_cohorts(pitcher_silver(spark, d), gd.GoldConfig()).frames


register("archetype_assignments")(lambda spark, d: _archetypes(spark, d))


def _archetypes(spark, d):
    from functools import reduce

    from .clustering import ClusterSpec, fit_cohorts

    frames = _pitcher_gold(spark, d)
    cfg = ClusterSpec(pca_n_components=3, n_clusters=3, n_init=1)
    results = fit_cohorts(frames, {k: cfg for k in frames})
    out = []
    for key, res in sorted(results.items()):
        if isinstance(res, Exception):
            raise res
        out.append(res[0].select("player_id", "role", "year", "cluster_id"))
    return reduce(lambda x, y: x.unionByName(y), out)


register("similarity_neighbors")(lambda spark, d: _similarity(spark, d))


def _similarity(spark, d):
    from ..operators import gold as gd
    from ..session import cut_lineage
    from .queries_gold import pitcher_silver

    silver = pitcher_silver(spark, d)
    base, _, _ = gd.prepare(silver, gd.GoldConfig())
    base = cut_lineage(base)  # the model, the projection and the search read it many times
    feats = sc.model_feature_columns(base)
    model = sc.fit_pca(base, feats, 5, ["role", "year"])
    proj = sc.transform(base, model, "pca")
    return finalize(knn_ops.neighbor_table(proj, vec_col="pca", k=5, cohort=("role", "year"), name_col=None), 9)
