"""Registered model queries with parameters given by rule, so that SQL can compute the same.

Fits end where their start leads them, which SQL cannot follow; labelling, scoring
and projecting with given parameters it can. The parameters below are the same
rules on both sides."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import mixture as mx
from ..operators import scaling as sc
from .queries_ml import _E, _emb, _emb_features
from .registry import finalize, r, register

D, CLUSTERS = 64, 3
WEIGHTS = (0.5, 0.3, 0.2)


def _mean(i: int, j: int) -> float:
    return ((i * 7 + j * 13) % 11 - 5) / 20


def _variance(i: int, j: int) -> float:
    return 0.5 + ((i + j) % 5) / 10


_MEAN_SQL = "((i * 7 + {j} * 13) % 11 - 5) / 20"
_VARIANCE_SQL = "(0.5 + ((i + {j}) % 5) / 10)"
MEANS = np.array([[_mean(i, j) for i in range(D)] for j in range(CLUSTERS)])


def _mixture(kind: str) -> mx.Mixture:
    variances = np.array([[_variance(i, j) for i in range(D)] for j in range(CLUSTERS)])
    return mx.Mixture(kind, np.array(WEIGHTS), MEANS, variances if kind == "diag" else np.array([0.5 + j / 10 for j in range(CLUSTERS)]))


def _log_density(kind: str, j: int) -> str:
    """log w + log N of component ``j``, in SQL."""
    variance = _VARIANCE_SQL.format(j=j) if kind == "diag" else f"(0.5 + {j} / 10)"
    term = f"ln({variance}) + pow(v[i + 1] - {_MEAN_SQL.format(j=j)}, 2) / {variance}"
    return f"(ln({WEIGHTS[j]}) - 0.5 * ({D} * {math.log(2 * math.pi):.17e} + list_sum(list_transform(range({D}), lambda i: {term}))))"


def _densities(kind: str) -> str:
    return ", ".join(f"{_log_density(kind, j)} AS g{j}" for j in range(CLUSTERS))


_BEST = "CASE WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END"
_LIKELIHOOD = "greatest(g0, g1, g2) + ln(exp(g0 - greatest(g0, g1, g2)) + exp(g1 - greatest(g0, g1, g2)) + exp(g2 - greatest(g0, g1, g2)))"

# Most probable component under given parameters
register(
    "gmm_fixed_labels",
    f"""WITH {_E}, g AS (SELECT vec_id, label, {_densities('diag')} FROM e)
SELECT vec_id, label, {_BEST} AS cluster_id FROM g""",
)(lambda spark, d: mx.predict(_emb(spark, d), "v", {(): _mixture("diag")}).select("vec_id", "label", "cluster_id"))


def _scores_sql(kind: str) -> str:
    p = _mixture(kind).n_parameters()
    return f"""SELECT '{kind}' AS covariance_type, COUNT(*) AS n, {r('AVG(ll)', 8)} AS mean_log_likelihood,
  {r(f'-2 * SUM(ll) + 2 * {p}', 5)} AS aic, {r(f'-2 * SUM(ll) + {p} * ln(COUNT(*))', 5)} AS bic
FROM (SELECT {_LIKELIHOOD} AS ll FROM (SELECT {_densities(kind)} FROM e) g) s"""


def gmm_fixed_scores(spark, d):
    e, out = _emb(spark, d), None
    for kind in ("diag", "spherical"):
        s = mx.score(e, "v", {(): _mixture(kind)}).select(
            F.lit(kind).alias("covariance_type"), "n", F.round("mean_log_likelihood", 8).alias("mean_log_likelihood"),
            F.round("aic", 5).alias("aic"), F.round("bic", 5).alias("bic"))
        out = s if out is None else out.unionByName(s)
    return out


# Likelihood, AIC and BIC under given parameters
register("gmm_fixed_scores", f"WITH {_E}\n{_scores_sql('diag')}\nUNION ALL\n{_scores_sql('spherical')}")(gmm_fixed_scores)

# Nearest of given centres
register(
    "kmeans_fixed_labels",
    f"WITH {_E}, g AS (SELECT vec_id, "
    + ", ".join(f"-list_sum(list_transform(range({D}), lambda i: pow(v[i + 1] - {_MEAN_SQL.format(j=j)}, 2))) AS g{j}" for j in range(CLUSTERS))
    + f" FROM e) SELECT vec_id, {_BEST} AS cluster_id FROM g",
)(lambda spark, d: mx.assign_nearest(_emb(spark, d), "v", {(): MEANS}).select("vec_id", "cluster_id"))


# Projection by a saved and reloaded model of given loadings
def _fixed_projection(spark, d):
    import uuid

    from ..session import ensure_checkpoint_dir

    wide, cols = _emb_features(spark, d)
    model = sc.PcaModel(cols, [])
    scale = np.array([1 + (i % 3) / 4 for i in range(D)])
    model.params[()] = {"n": 2, "mean": MEANS[0], "scale": scale, "components": MEANS[1:], "evr": np.ones(2), "ev": np.ones(2)}
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fixed-{uuid.uuid4().hex}"
    model.save(spark, path)
    z = sc.transform(wide, sc.PcaModel.load(spark, path), "z")
    return finalize(z.select("vec_id", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1")), 9)


def _loading_sql(j: int) -> str:
    term = f"(v[i + 1] - {_MEAN_SQL.format(j=0)}) / (1 + (i % 3) / 4) * {_MEAN_SQL.format(j=j)}"
    return r(f"list_sum(list_transform(range({D}), lambda i: {term}))", 9)


register("project_fixed_model", f"WITH {_E} SELECT vec_id, {_loading_sql(1)} AS z0, {_loading_sql(2)} AS z1 FROM e")(_fixed_projection)


# The similarity job over two cohorts, each with the saved model that lies beside it
_Z = ", ".join(f"list_sum(list_transform(range({D}), lambda i: (v[i + 1] - {_MEAN_SQL.format(j=0)}) / (1 + (i % 3) / 4) * {_MEAN_SQL.format(j=j)})) AS z{j}" for j in (1, 2))
register(
    "similarity_saved_model",
    f"""WITH {_E}, z AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'batter' ELSE 'pitcher' END AS role, {_Z} FROM e),
p AS (SELECT a.role, a.vec_id, b.vec_id AS other, sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)) AS distance
      FROM z a JOIN z b ON a.role = b.role AND a.vec_id <> b.vec_id),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY role, vec_id ORDER BY distance, other) AS neighbor_rank FROM p)
SELECT vec_id AS player_id, role, CAST(2024 AS INT) AS year, CAST(neighbor_rank AS INT) AS neighbor_rank, other AS neighbor_player_id, ROUND(distance, 9) AS distance
FROM n WHERE neighbor_rank <= 5""",
)(lambda spark, d: similarity_saved_model(spark, d))


def similarity_saved_model(spark, d):
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import lake
    from .clustering import build_similarity

    wide, cols = _emb_features(spark, d)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/similar-{uuid.uuid4().hex}"
    role = F.when(F.col("vec_id") % 2 == 0, "batter").otherwise("pitcher")
    gold = wide.select(F.col("vec_id").alias("player_id"), role.alias("role"), F.lit(2024).alias("year"), *cols)
    lake.write_partitioned(gold, f"{root}/gold", ("role", "year"))
    scale = np.array([1 + (i % 3) / 4 for i in range(D)])
    for name in ("batter", "pitcher"):
        model = sc.PcaModel(cols, [], {(): {"n": 2, "mean": MEANS[0], "scale": scale, "components": MEANS[1:], "evr": np.ones(2), "ev": np.ones(2)}})
        model.save(spark, f"{root}/models/role={name}/year=2024/pca")
    done = build_similarity(spark, gold_root=f"{root}/gold", model_root=f"{root}/models", out_root=f"{root}/out", years=[2024], k_neighbors=5)
    if done["status"] != "ok":
        raise ValueError(f"similarity: {done}")
    near = lake.read_partitioned(spark, f"{root}/out/neighbors")
    return finalize(near.select("player_id", "role", "year", F.col("neighbor_rank").cast("int").alias("neighbor_rank"), "neighbor_player_id", "distance"), 9)


# M6 / M7: what holds for any right principal components, from the fitted model and the projected rows
register(
    "pca_invariants",
    f"""WITH {_E}, z AS (SELECT unnest(range(1, 11)) AS component)
SELECT CAST(component AS INT) AS component, 1E0 AS norm, 0E0 AS overlap, 0E0 AS mean, 0E0 AS variance_gap, 1E0 AS ratio_sum,
  (SELECT COUNT(*) FROM e) AS n_rows FROM z""",
)(lambda spark, d: pca_invariants(spark, d))


def pca_invariants(spark, d):
    """Unit length, no overlap with other components, centred scores whose variance is the eigenvalue, ratios that sum to one."""
    wide, cols = _emb_features(spark, d)
    model = sc.fit_pca(wide, cols, D)
    fitted = model.params[()]
    gram = fitted["components"] @ fitted["components"].T
    z = sc.transform(wide, model, "z")
    scores = z.select(F.posexplode("z").alias("pos", "z")).where("pos < 10").groupBy("pos").agg(
        F.avg("z").alias("mean"), F.var_samp("z").alias("variance"), F.count("z").alias("n_rows"))
    rule = [(k, float(gram[k, k]), float(np.abs(np.delete(gram[k], k)).max()), float(fitted["ev"][k]), float(fitted["evr"].sum())) for k in range(10)]
    known = spark.createDataFrame(rule, "pos int, norm double, overlap double, ev double, ratio_sum double")
    return finalize(scores.join(known, "pos").select(
        (F.col("pos") + 1).cast("int").alias("component"), "norm", F.abs("overlap").alias("overlap"), F.abs("mean").alias("mean"),
        F.abs(F.col("variance") - F.col("ev")).alias("variance_gap"), "ratio_sum", "n_rows"), 8)


# EM from given parameters; SQL follows the same passes for every covariance type in two dimensions ------------
EM_PASSES = 3
_POINTS = "SELECT p_partkey, p_size / 10E0 AS x, CAST(p_retailprice AS DOUBLE) / 400 AS y FROM part"
#: component, weight, means and variances of the start
_EM_START = ((0, 0.6, 1.5, 2.5, 1.0, 0.5), (1, 0.4, 3.5, 3.5, 1.5, 0.75))


def _em_sql(kind: str) -> str:
    """Parameters (component, w, mx, my, xx, xy, yy) after each pass, one common table a pass."""
    start = ["(" + ", ".join(map(str, (j, w, mx, my, *_em_start_covariance(kind, vx, vy)))) + ")" for j, w, mx, my, vx, vy in _EM_START]
    tables = [f"points AS ({_POINTS})", f"p0 AS (SELECT * FROM (VALUES {', '.join(start)}) v(component, w, mx, my, xx, xy, yy))"]
    for step in range(EM_PASSES + 1):
        tables.append(f"""g{step} AS (SELECT p_partkey, component, x, y, ln(w) - ln(2 * pi()) - 0.5 * ln(xx * yy - xy * xy)
  - 0.5 * ((x - mx) * (x - mx) * yy - 2 * (x - mx) * (y - my) * xy + (y - my) * (y - my) * xx) / (xx * yy - xy * xy) AS g FROM points, p{step}),
n{step} AS (SELECT p_partkey, MAX(g) AS top, MAX(g) + ln(SUM(exp(g - top))) AS ll FROM (SELECT *, MAX(g) OVER (PARTITION BY p_partkey) AS top FROM g{step}) q GROUP BY p_partkey)""")
        if step < EM_PASSES:
            tables.append(f"""s{step} AS (SELECT component, SUM(r) AS nk, SUM(r * x) / SUM(r) AS mx, SUM(r * y) / SUM(r) AS my, (SELECT COUNT(*) FROM points) AS n,
  SUM(r * x * x) / SUM(r) - POW(SUM(r * x) / SUM(r), 2) AS vx, SUM(r * y * y) / SUM(r) - POW(SUM(r * y) / SUM(r), 2) AS vy,
  SUM(r * x * y) / SUM(r) - SUM(r * x) / SUM(r) * SUM(r * y) / SUM(r) AS vxy
  FROM (SELECT component, x, y, exp(g - ll) AS r FROM g{step} JOIN n{step} USING (p_partkey)) q GROUP BY component),
p{step + 1} AS (SELECT component, nk / n AS w, mx, my, {_EM_COVARIANCE[kind]} FROM s{step})""")
    steps = " UNION ALL ".join(
        f"SELECT '{kind}' AS covariance_type, {s} AS step, component, w, mx, my, xx, xy, yy, (SELECT AVG(ll) FROM n{s}) AS ll FROM p{s}" for s in range(EM_PASSES + 1))
    return f"(WITH {', '.join(tables)} {steps})"


def _em_start_covariance(kind: str, vx: float, vy: float) -> tuple[float, float, float]:
    if kind == "spherical":
        return vx, 0.0, vx
    return (1.25, 0.125, 0.625) if kind == "tied" else (vx, 0.25 if kind == "full" else 0.0, vy)


_TIED = "SUM(nk * {}) OVER () / SUM(nk) OVER ()"
_EM_COVARIANCE = {
    "full": "vx + 1E-6 AS xx, vxy AS xy, vy + 1E-6 AS yy",
    "tied": f"{_TIED.format('vx')} + 1E-6 AS xx, {_TIED.format('vxy')} AS xy, {_TIED.format('vy')} + 1E-6 AS yy",
    "diag": "greatest(vx, 0) + 1E-6 AS xx, 0E0 AS xy, greatest(vy, 0) + 1E-6 AS yy",
    "spherical": "(greatest(vx, 0) + greatest(vy, 0)) / 2 + 1E-6 AS xx, 0E0 AS xy, (greatest(vx, 0) + greatest(vy, 0)) / 2 + 1E-6 AS yy",
}


def gmm_em_passes(spark, d):
    from .. import fixtures as fx

    points = fx.table(spark, d, "part").select(F.array(F.col("p_size") / F.lit(10.0), F.col("p_retailprice").cast("double") / 400).alias("v"))
    out = None
    for kind in mx.COVARIANCE_TYPES:
        held = [_em_start_covariance(kind, vx, vy) for *_, vx, vy in _EM_START]
        covs = {
            "full": [[[a, b], [b, c]] for a, b, c in held], "tied": [[held[0][0], held[0][1]], [held[0][1], held[0][2]]],
            "diag": [[a, c] for a, _, c in held], "spherical": [a for a, _, _ in held],
        }[kind]
        start = mx.Mixture(kind, np.array([row[1] for row in _EM_START]), np.array([row[2:4] for row in _EM_START]), np.array(covs))
        rows = mx.fit_from(points, "v", {(): start}, EM_PASSES)
        c = F.col("covariance")
        xx, xy, yy = {"diag": (c[0], F.lit(0.0), F.get(c, 1)), "spherical": (c[0], F.lit(0.0), c[0])}.get(kind, (c[0], F.get(c, 1), F.get(c, 3)))
        rows = rows.select(
            F.lit(kind).alias("covariance_type"), "step", "component", F.col("weight").alias("w"), F.col("mean")[0].alias("mx"), F.col("mean")[1].alias("my"),
            xx.alias("xx"), xy.alias("xy"), yy.alias("yy"), F.col("mean_log_likelihood").alias("ll"))
        out = rows if out is None else out.unionByName(rows)
    return finalize(out, 7)


register(
    "gmm_em_passes",
    "SELECT covariance_type, CAST(step AS INT) AS step, CAST(component AS INT) AS component, "
    + ", ".join(f"ROUND({c}, 7) AS {c}" for c in ("w", "mx", "my", "xx", "xy", "yy", "ll"))
    + f" FROM ({' UNION ALL '.join(f'SELECT * FROM {_em_sql(kind)} {kind}_t' for kind in mx.COVARIANCE_TYPES)}) t",
)(gmm_em_passes)


# The whole spectrum against the covariance itself: its trace, and the traces of its square and cube -------
def pca_spectrum(spark, d):
    wide, cols = _emb_features(spark, d)
    model = sc.fit_pca(wide, cols, D, ["label"])
    z = sc.transform(sc.transform(wide, _scaler_only(model), "u"), model, "z")
    rows = []
    both = z.select("label", F.concat("u", "z").alias("uz"), F.size("z").alias("k"))
    for k in sorted({p["components"].shape[0] for p in model.params.values()}):
        grams = sc.gram_by_cohort(both.where(F.col("k") == k), "uz", D + k, ["label"], None)
        for key, g in grams.items():
            p = model.params[key]
            held = g[:D, D:] / (p["n"] - 1)  # the covariance times each component, from the rows themselves
            gap = float(np.abs(held - p["components"].T * p["ev"]).max())
            rows.append((key[0], k, *[float((p["ev"] ** e).sum()) for e in (1, 2, 3)], float(p["evr"].sum()), gap))
    schema = "label long, n_components int, trace_1 double, trace_2 double, trace_3 double, cumulative double, largest_residual double"
    out = spark.createDataFrame(rows, schema)
    return out.select(out["label"].cast(wide.schema["label"].dataType).alias("label"), "n_components", *[F.round(f"trace_{e}", 5).alias(f"trace_{e}") for e in (1, 2, 3)],
                      F.round("cumulative", 8).alias("cumulative"), F.round("largest_residual", 8).alias("largest_residual"))


def _scaler_only(model: sc.PcaModel) -> sc.PcaModel:
    """The model's scaler with every direction of its own."""
    only = sc.PcaModel(model.feature_columns, model.cohort_columns)
    for key, p in model.params.items():
        only.params[key] = {**p, "components": np.eye(len(p["mean"]))}
    return only


register(
    "pca_spectrum",
    f"""WITH {_E}, u AS (SELECT vec_id, label, UNNEST(range(len(v))) AS i, UNNEST(v) AS x FROM e),
s AS (SELECT vec_id, label, i, (x - AVG(x) OVER w) / CASE WHEN STDDEV_POP(x) OVER w > 0 THEN STDDEV_POP(x) OVER w ELSE 1 END AS z FROM u WINDOW w AS (PARTITION BY label, i)),
n AS (SELECT label, COUNT(*) AS n FROM e GROUP BY label),
c AS (SELECT a.label, a.i, b.i AS j, SUM(a.z * b.z) / (MAX(n.n) - 1) AS c FROM s a JOIN s b ON a.vec_id = b.vec_id JOIN n ON n.label = a.label GROUP BY a.label, a.i, b.i),
q AS (SELECT a.label, a.i, b.j, SUM(a.c * b.c) AS c FROM c a JOIN c b ON a.label = b.label AND a.j = b.i GROUP BY a.label, a.i, b.j),
t AS (SELECT c.label, SUM(CASE WHEN c.i = c.j THEN c.c END) AS trace_1, SUM(c.c * c.c) AS trace_2, SUM(c.c * q.c) AS trace_3
      FROM c JOIN q ON c.label = q.label AND c.i = q.i AND c.j = q.j GROUP BY c.label)
SELECT t.label, CAST(LEAST({D}, n.n - 1) AS INT) AS n_components, ROUND(trace_1, 5) AS trace_1, ROUND(trace_2, 5) AS trace_2, ROUND(trace_3, 5) AS trace_3,
  1E0 AS cumulative, 0E0 AS largest_residual FROM t JOIN n ON t.label = n.label""",
)(pca_spectrum)
