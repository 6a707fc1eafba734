"""Gold -> clusters (M9-M13, M20) and gold -> neighbours.

For each (role, year) cohort: standardise (population std) -> PCA -> Gaussian
mixture (best of ``n_init``) -> assignments + quality scores + metadata.
``fit_cohorts`` takes all cohorts through each step in the same jobs; only
parameters reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knn as knn_ops
from ..operators import metrics as mt
from ..operators import mixture as mx
from ..operators import scaling as sc
from ..operators.gold import assert_no_missing
from ..session import cut_lineage
from ..sources import lake
from .gold import roles_for

MIN_SAMPLES = 3
COHORT = ("role", "year")
METRICS = ("minkowski", "euclidean", "manhattan", "chebyshev")


@dataclass(frozen=True)
class ClusterSpec:
    """What to fit: principal components, clusters and how the mixture starts."""

    pca_n_components: int
    n_clusters: int
    random_state: int = 42
    n_init: int = 10
    covariance_type: str = "full"


#: a spec for all cohorts, or one per role
Specs = ClusterSpec | Mapping[str, ClusterSpec]


def spec_of(specs: Specs, role: str) -> ClusterSpec:
    if isinstance(specs, ClusterSpec):
        return specs
    try:
        return specs[role]
    except KeyError:
        raise ValueError(f"no cluster spec for role {role!r}; there are {sorted(specs)}") from None


def spec_faults(spec: ClusterSpec, features: Sequence[str], n: int, missing: Mapping[str, int]) -> list[str]:
    """Everything that keeps a cohort of ``n`` rows from being fitted."""
    rules = {
        f"{spec.n_clusters} clusters asked for, 2 are the least": spec.n_clusters < 2,
        f"{spec.pca_n_components} principal components asked for, 1 is the least": spec.pca_n_components < 1,
        f"unknown covariance {spec.covariance_type!r}, known are {', '.join(mx.COVARIANCE_TYPES)}": spec.covariance_type not in mx.COVARIANCE_TYPES,
        "no numeric feature": not features,
        f"{n} rows, {MIN_SAMPLES} are the least": n < MIN_SAMPLES,
        f"{spec.n_clusters} clusters for {n} rows": spec.n_clusters > n >= MIN_SAMPLES,
        "missing values: " + ", ".join(f"{c} ({k})" for c, k in sorted(missing.items())): bool(missing),
    }
    return [fault for fault, holds in rules.items() if holds]


def feature_hash(cols) -> str:
    return hashlib.sha256(",".join(cols).encode()).hexdigest()[:16]


def cohort_metadata(role: str, year: int, n: int, spec: ClusterSpec, pca: sc.PcaModel, gmm: mx.Mixture, index: Sequence[str], scores: Mapping[str, float | None]) -> dict:
    """The cohort's JSON document. Its key names are a fixed contract."""
    fitted = pca.params[()]
    features = list(pca.feature_columns)
    document = {"role": role, "year": int(year), "n_samples": int(n), **{k: v for k, v in asdict(spec).items() if k != "covariance_type"}}
    document |= {"n_features_used": len(features), "feature_columns": features, "feature_columns_sha256_16": feature_hash(features)}
    document |= {"clustering_index_columns": list(index), "clustering_method": "gaussian_mixture"}
    ratios = [float(x) for x in fitted["evr"]]
    document |= {"pca_n_components": len(fitted["components"]), "pca_explained_variance_ratio": ratios, "pca_total_explained_variance": sum(ratios)}
    document |= {"gmm_covariance_type": gmm.covariance_type, "gmm_lower_bound": float(gmm.lower_bound), "gmm_converged": bool(gmm.converged), "gmm_n_iter": int(gmm.n_iter)}
    return document | dict(scores) | {"config": asdict(spec)}


def fit_cohort(df: DataFrame, *, role: str, year: int, config: ClusterSpec, id_col: str = "player_id"):
    """(assignments, metadata, (PCA model, mixture)) of one cohort; ValueError names every fault of its input."""
    result = fit_cohorts({(role, year): df}, {(role, year): config}, id_col=id_col)[(role, year)]
    if isinstance(result, Exception):
        raise result
    return result


def fit_cohorts(frames: dict[tuple, DataFrame], configs: dict[tuple, ClusterSpec], *, id_col: str = "player_id") -> dict[tuple, object]:
    """What ``fit_cohort`` gives, for many (role, year) cohorts in the same jobs: {key: result or exception}.

    The rows of all cohorts are one table, each with a vector of its cohort's own features. Checks, moments, components
    and projections take one pass each whatever the number of cohorts; those of one spec share every pass of the
    mixture fit, and one that has converged leaves it. Where a shared fit fails, its cohorts are fitted one by one,
    so that only the failing ones are reported."""
    if not frames:
        return {}
    features = {key: sc.model_feature_columns(df) for key, df in frames.items()}
    rows = cut_lineage(sc.stacked(frames, features, COHORT, dict.fromkeys((id_col, *sc.INDEX_COLUMNS))))
    moments = sc.stacked_moments(rows, features, COHORT)
    results: dict[tuple, object] = {}
    for key, names in features.items():
        m = moments.get(key, {"n": 0, "count": [0] * len(names)})
        missing = {c: m["n"] - int(k) for c, k in zip(names, m["count"]) if k < m["n"]}
        if faults := spec_faults(configs[key], names, m["n"], missing):
            results[key] = ValueError(f"{key[0]} {key[1]}: " + "; ".join(faults))
    sound = [key for key in frames if key not in results]
    if not sound:
        return results
    rows = _of(rows, sound, frames)
    pcas = sc.fit_pca_stacked(rows, features, {key: configs[key].pca_n_components for key in sound}, {key: moments[key] for key in sound}, COHORT)
    points = cut_lineage(sc.transform_stacked(rows, pcas, COHORT))
    alike: dict[tuple, list[tuple]] = {}
    for key in sound:
        alike.setdefault((configs[key], pcas[key].n_components()), []).append(key)
    for (spec, _), keys in alike.items():
        part = _of(points, keys, sound)
        try:
            fits = _fit_alike(part, spec, keys, moments, id_col)
        except Exception as shared:
            fits = {keys[0]: shared} if len(keys) == 1 else {}
            for key in keys if len(keys) > 1 else ():
                try:
                    fits |= _fit_alike(_of(part, [key], keys), spec, [key], moments, id_col)
                except Exception as own:  # reported for this cohort
                    fits[key] = own
        for key, fit in fits.items():
            if not isinstance(fit, Exception):
                labelled, gmm, scores = fit
                types = frames[key].schema
                index = [c for c in sc.INDEX_COLUMNS if c in frames[key].columns]
                own = [F.col("_f")[i].cast(types[c].dataType).alias(c) for i, c in enumerate(features[key])]
                assignments = labelled.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in index], *own, "cluster_id")
                fit = assignments, cohort_metadata(*key, moments[key]["n"], spec, pcas[key], gmm, index, scores), (pcas[key], gmm)
            results[key] = fit
    return results


def _of(rows: DataFrame, keys, among) -> DataFrame:
    """The rows of these cohorts; all of them where there are no others."""
    if len(keys) == len(among):
        return rows
    return rows.where(F.struct(*COHORT).isin([F.struct(*[F.lit(v) for v in key]) for key in keys]))


def _fit_alike(points: DataFrame, spec: ClusterSpec, keys: Sequence[tuple], moments: Mapping[tuple, dict], id_col: str) -> dict[tuple, tuple]:
    """{cohort: (its labelled rows, mixture, scores)} of cohorts that share a spec."""
    gmms = mx.fit_mixture(
        points, "_pca", spec.n_clusters, cohort=COHORT, covariance_type=spec.covariance_type, n_init=spec.n_init, seed=spec.random_state, checkpoint=False
    )
    labelled = mx.predict(points, "_pca", gmms, COHORT, out_col="cluster_id").persist()
    by_key = lambda df: {tuple(r[c] for c in COHORT): r for r in df.collect()}
    try:
        likelihood = by_key(mx.score(points, "_pca", gmms, COHORT))
        shaped = [key for key in keys if moments[key]["n"] > spec.n_clusters]
        shape = by_key(mt.silhouette(_of(labelled, shaped, keys), id_col=id_col, vec_col="_pca", label_col="cluster_id", cohort=COHORT)) if shaped else {}
        spread = by_key(mt.davies_bouldin(labelled, "_pca", "cluster_id", COHORT))
    finally:
        labelled.unpersist()
    out = {}
    for key in keys:
        scores = {
            "gmm_aic": float(likelihood[key]["aic"]),
            "gmm_bic": float(likelihood[key]["bic"]),
            "silhouette_score": shape[key]["silhouette"] if key in shape else None,
            "davies_bouldin_score": spread[key]["davies_bouldin"],
        }
        out[key] = (_of(labelled, [key], keys), gmms[key], scores)
    return out


def build_clustering(
    spark: SparkSession,
    *,
    gold_root: str,
    out_root: str,
    years,
    role_filter: str = "all",
    specs: Specs,
) -> dict:
    """Every cohort found; per-cohort failures are collected, the rest continue."""
    roles = roles_for(role_filter)
    gold = lake.read_partitioned(spark, gold_root)
    keys = [(r["role"], int(r["year"])) for r in gold.where(F.col("role").isin(*roles) & F.col("year").isin(*list(years)))
            .select("role", "year").distinct().collect()]
    errors, done, metas = [], [], []
    frames, configs = {}, {}
    for role, year in sorted(keys):
        try:
            configs[(role, year)] = spec_of(specs, role)
            cohort = lake.read_parquet_or_none(spark, lake.role_year_path(gold_root, role, year))
            frames[(role, year)] = cohort.withColumn("role", F.lit(role)).withColumn("year", F.lit(year))
        except Exception as exc:
            errors.append({"role": role, "year": year, "error": str(exc)})
    for (role, year), res in sorted(fit_cohorts(frames, configs).items()):
        if isinstance(res, Exception):
            errors.append({"role": role, "year": year, "error": str(res)})
            continue
        try:
            assignments, meta, (pca, gmm) = res
            lake.write_partitioned(assignments, lake.join_path(out_root, "assignments"), ("role", "year"))
            pca.save(spark, lake.join_path(out_root, "models", f"role={role}", f"year={year}", "pca"))
            mx.save_mixtures(spark, lake.join_path(out_root, "models", f"role={role}", f"year={year}", "gmm"), {(): gmm})
            metas.append(meta)
            done.append({"role": role, "year": year, "rows": meta["n_samples"]})
        except Exception as exc:  # per-cohort failure is recorded
            errors.append({"role": role, "year": year, "error": str(exc)})
    if metas:
        lake.write_metadata(spark, lake.join_path(out_root, "metadata"), metas)
    status = "ok" if not errors else ("partial" if done else "error")
    return {"status": status, "role_years_processed": done, "errors": errors}


def build_similarity(
    spark: SparkSession,
    *,
    gold_root: str,
    model_root: str,
    out_root: str,
    years,
    role_filter: str = "all",
    k_neighbors: int = 10,
    metric: str = "minkowski",
    minkowski_p: float = 2.0,
) -> dict:
    """M21 + J7: project each cohort with its saved model, then one KNN job over
    all projected cohorts (the cohort key is part of the block join)."""
    if k_neighbors < 1:
        return {"status": "error", "message": "k_neighbors must be >= 1", "errors": []}
    if metric not in METRICS:
        return {"status": "error", "message": f"metric must be one of {METRICS}", "errors": []}
    roles = roles_for(role_filter)
    gold = lake.read_partitioned(spark, gold_root)
    keys = [(r["role"], int(r["year"])) for r in gold.where(F.col("role").isin(*roles) & F.col("year").isin(*list(years)))
            .select("role", "year").distinct().collect()]
    projected, errors, meta = None, [], []
    for role, year in sorted(keys):
        path = lake.join_path(model_root, f"role={role}", f"year={year}", "pca")
        model = lake.read_parquet_or_none(spark, path)
        if model is None:
            errors.append({"role": role, "year": year, "error": f"missing model at {path}"})
            continue
        try:
            pca = sc.PcaModel.load(spark, path)
            cohort = lake.read_parquet_or_none(spark, lake.role_year_path(gold_root, role, year))
            cohort = cohort.withColumn("role", F.lit(role)).withColumn("year", F.lit(year))
            assert_no_missing(cohort, [c for c in pca.feature_columns if c in cohort.columns], "feature matrix")
            pr = sc.transform(cohort, pca, "_pca").select("player_id", *(["player_name"] if "player_name" in cohort.columns else []),
                                                          "role", "year", "_pca")
            projected = pr if projected is None else projected.unionByName(pr, allowMissingColumns=True)
            n = pr.count()
            meta.append({"role": role, "year": year, "k_requested": k_neighbors, "k_effective": knn_ops.effective_k(k_neighbors, n),
                         "metric": metric, "minkowski_p": minkowski_p, "n_samples": n})
        except Exception as exc:
            errors.append({"role": role, "year": year, "error": str(exc)})
    if projected is not None:
        table = knn_ops.neighbor_table(projected, vec_col="_pca", k=k_neighbors, metric=metric, p=minkowski_p)
        lake.write_partitioned(table, lake.join_path(out_root, "neighbors"), ("role", "year"))
        lake.write_metadata(spark, lake.join_path(out_root, "metadata"), meta)
    status = "ok" if not errors else ("partial" if meta else "error")
    return {"status": status, "cohorts": meta, "errors": errors}

