"""Parameter sweeps for PCA size x cluster count (M16-M19, T-5).

One PCA with the largest requested size is fitted; smaller sizes reuse its
leading components (they nest), so each grid point costs only the clustering
fit and its quality metrics -- all distributed jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as mt
from . import mixture as mx
from . import scaling as sc


def _clamp_k(k_min: int, k_max: int, n: int) -> range:
    k_max = max(min(k_max, n - 1), k_min)
    return range(k_min, k_max + 1)


def _quality(labelled: DataFrame, id_col: str, vec_col: str, label_of: dict[int, str], n: int) -> dict[int, tuple[float | None, float | None]]:
    """Silhouette and Davies-Bouldin per k, from one pass over the distances for all k. None unless 2 <= k < n."""
    label_of = {k: c for k, c in label_of.items() if 2 <= k < n}
    if not label_of:
        return {}
    found = mt.silhouettes(labelled, id_col=id_col, vec_col=vec_col, label_cols=list(label_of.values())).collect()  # a row for each k
    silhouette = {r["labelling"]: r["silhouette"] for r in found}
    return {k: (silhouette[c], mt.davies_bouldin(labelled, vec_col, c).first()["davies_bouldin"]) for k, c in label_of.items()}


def kmeans_sweep(df: DataFrame, *, id_col: str, vec_col: str, k_min: int, k_max: int, seed: int = 42, n_init: int = 1) -> list[dict]:
    """Inertia, silhouette, Davies-Bouldin per k (k_max clamped to n-1, at
    least k_min). All k are fitted together (``mixture.fit_kmeans``)."""
    from ..session import cut_lineage

    data = cut_lineage(df.select(id_col, F.col(vec_col).cast("array<double>").alias("_v")))
    n = data.count()
    ks = list(_clamp_k(k_min, k_max, n))
    fits = mx.fit_kmeans(data, "_v", ks, n_init=n_init, seed=seed, checkpoint=False)
    labelled = cut_lineage(mx.assign_nearest_all(data, "_v", {f"_k{k}": {(): fits[((), k)][0]} for k in ks}))
    quality = _quality(labelled, id_col, "_v", {k: f"_k{k}" for k in ks}, n)
    out = []
    for k in ks:
        sil, db = quality.get(k, (None, None))
        out.append({"k": k, "inertia": float(fits[((), k)][1]), "silhouette": sil, "davies_bouldin": db})
    return out


def gmm_sweep(
    df: DataFrame, *, id_col: str, vec_col: str, k_min: int, k_max: int, seed: int = 42, n_init: int = 1,
    covariance_type: str = "full",
) -> list[dict]:
    """AIC, BIC, lower bound, silhouette, Davies-Bouldin per number of
    components. All k are fitted together (``mixture.fit_mixtures``)."""
    from ..session import cut_lineage

    data = cut_lineage(df.select(id_col, F.col(vec_col).cast("array<double>").alias("_v")))
    n = data.count()
    ks = list(_clamp_k(k_min, k_max, n))
    fits = mx.fit_mixtures(data, "_v", ks, covariance_type=covariance_type, n_init=n_init, seed=seed, checkpoint=False)
    labelled = cut_lineage(mx.predict_all(data, "_v", {f"_k{k}": {(): fits[((), k)]} for k in ks}))
    quality = _quality(labelled, id_col, "_v", {k: f"_k{k}" for k in ks}, n)
    out = []
    for k in ks:
        models = {(): fits[((), k)]}
        s = mx.score(data, "_v", models).first()
        sil, db = quality.get(k, (None, None))
        out.append({"k": k, "gmm_aic": s["aic"], "gmm_bic": s["bic"], "gmm_lower_bound": models[()].lower_bound,
                    "silhouette": sil, "davies_bouldin": db})
    return out


def _pca_sizes(model: sc.PcaModel, sizes: Sequence[int]) -> list[int]:
    kmax = model.n_components(())
    return sorted({min(int(s), kmax) for s in sizes if min(int(s), kmax) >= 1})


def grid_sweep(
    spark: SparkSession,
    df: DataFrame,
    *,
    id_col: str,
    feature_cols: Sequence[str],
    pca_sizes: Sequence[int],
    k_min: int,
    k_max: int,
    method: str = "kmeans",
    seed: int = 42,
    n_init: int = 1,
    covariance_type: str = "full",
) -> DataFrame:
    """Long table (pca_n_components, pca_total_explained_variance, k, metrics...)."""
    model = sc.fit_pca(df, feature_cols, max(pca_sizes))
    proj = sc.transform(df, model, "_pca").select(id_col, "_pca")
    from ..session import cut_lineage

    proj = cut_lineage(proj)
    evr = model.params[()]["evr"]
    rows = []
    for npc in _pca_sizes(model, pca_sizes):
        sub = proj.select(id_col, F.slice("_pca", 1, npc).alias("_z"))
        total = float(sum(evr[:npc]))
        if method == "kmeans":
            curve = kmeans_sweep(sub, id_col=id_col, vec_col="_z", k_min=k_min, k_max=k_max, seed=seed, n_init=n_init)
        else:
            curve = gmm_sweep(sub, id_col=id_col, vec_col="_z", k_min=k_min, k_max=k_max, seed=seed, n_init=n_init,
                              covariance_type=covariance_type)
        for m in curve:
            rec = {"pca_n_components": npc, "pca_total_explained_variance": total}
            if method != "kmeans":
                rec["gmm_covariance_type"] = covariance_type
            rec.update(m)
            rows.append(rec)
    if method == "kmeans":
        schema = ("pca_n_components int, pca_total_explained_variance double, k int, inertia double, "
                  "silhouette double, davies_bouldin double")
        cols = ["pca_n_components", "pca_total_explained_variance", "k", "inertia", "silhouette", "davies_bouldin"]
    else:
        schema = ("pca_n_components int, pca_total_explained_variance double, gmm_covariance_type string, k int, "
                  "gmm_aic double, gmm_bic double, gmm_lower_bound double, silhouette double, davies_bouldin double")
        cols = ["pca_n_components", "pca_total_explained_variance", "gmm_covariance_type", "k", "gmm_aic", "gmm_bic",
                "gmm_lower_bound", "silhouette", "davies_bouldin"]
    data = [tuple(None if r.get(c) is None else (float(r[c]) if isinstance(r[c], float) or hasattr(r[c], "dtype") else r[c]) for c in cols) for r in rows]
    return spark.createDataFrame(data, schema)


def top_by(grid: DataFrame, metric: str, *, ascending: bool = True, n: int = 25) -> DataFrame:
    """T-5: the best ``n`` grid rows by a metric (a top-k report)."""
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return grid.orderBy(order, "pca_n_components", "k").limit(n)


def best_row(grid: DataFrame, metric: str, *, ascending: bool = True) -> DataFrame:
    """T-5: the single best grid point (``min_by`` / ``max_by`` over a struct of the row)."""
    row = F.struct(*[F.col(c) for c in grid.columns])
    pick = F.min_by(row, F.col(metric)) if ascending else F.max_by(row, F.col(metric))
    return grid.where(F.col(metric).isNotNull()).agg(pick.alias("_best")).select("_best.*")
