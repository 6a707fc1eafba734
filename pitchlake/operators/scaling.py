"""Standardisation and PCA per cohort.

* Moments (mean, population std) come from one grouped aggregate.
* The covariance of the standardised features is reduced on executors: each
  partition computes its partial Gram matrix ``Z^T Z`` with NumPy inside
  ``mapInPandas`` and emits it as d*d (row, col, value) entries; one grouped
  ``sum`` merges them. Only the d x d matrix per cohort reaches the driver,
  where ``numpy.linalg.eigh`` gives the components.
* Projection is a plain column expression (flat multiply-adds, codegen); with
  cohorts, parameters arrive through an equi-join on the cohort key.

Standardisation uses the population std (zero std -> scale 1), unlike
``pyspark.ml.feature.StandardScaler`` which uses the sample std.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gold import ID_COLUMNS, numeric_columns

# Volume column kept out of model features.
EXCLUDED_FROM_MODEL = ("n_pitches_total",)
INDEX_COLUMNS = ("player_id", "player_name", "year", "role", "n_pitches_total")


def model_feature_columns(df: DataFrame, extra_exclude: Sequence[str] = ()) -> list[str]:
    """Sorted numeric columns minus ids and the volume column."""
    ex = set(ID_COLUMNS) | set(EXCLUDED_FROM_MODEL) | set(extra_exclude)
    return sorted(c for c in numeric_columns(df, exclude=()) if c not in ex)


def array_to_columns(df: DataFrame, array_col: str, prefix: str, width: int) -> DataFrame:
    return df.select("*", *[F.col(array_col)[i].cast("double").alias(f"{prefix}{i}") for i in range(width)])


def _key(row, cohort):
    return tuple(row[c] for c in cohort)


# ------------------------------------------------------------------ standardiser


def fit_standardizer(df: DataFrame, cols: Sequence[str], cohort: Sequence[str] = ()) -> dict[tuple, dict]:
    """Per cohort: n, mean and population std of each column (two NumPy moment
    passes on executors; the driver gets cohorts x d numbers). Zero or undefined
    std -> scale 1."""
    from .moments import column_moments

    vec = df.select(*cohort, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    out = {}
    for key, m in column_moments(vec, "_x", len(cols), cohort).items():
        sds = m["std"]
        scale = np.where((sds > 0) & np.isfinite(sds), sds, 1.0)
        out[key] = {"n": m["n"], "mean": m["mean"], "scale": scale}
    return out


def standardize_exprs(cols: Sequence[str], mean: Sequence[float], scale: Sequence[float], prefix: str = "z_") -> list[Column]:
    return [((F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s))).alias(f"{prefix}{c}") for c, m, s in zip(cols, mean, scale)]


def standardize_population(df: DataFrame, cols: Sequence[str], cohort: Sequence[str] = (), prefix: str = "z_") -> DataFrame:
    """M6: z = (x - mean) / std_pop per cohort, std 0 -> scale 1.

    Cohort statistics come from one aggregate joined back on the cohort key
    (one row per cohort, so the join side is tiny)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"_m{i}"), F.stddev_pop(x).alias(f"_s{i}")]
    if not cohort:
        st = fit_standardizer(df, cols)
        p = st[()]
        return df.select("*", *standardize_exprs(cols, p["mean"], p["scale"], prefix))
    stats = df.groupBy(*cohort).agg(*aggs)
    j = df.join(stats, list(cohort), "inner")
    zs = []
    for i, c in enumerate(cols):
        sd = F.col(f"_s{i}")
        scale = F.when(sd > 0, sd).otherwise(F.lit(1.0))
        zs.append(((F.col(c).cast("double") - F.col(f"_m{i}")) / scale).alias(f"{prefix}{c}"))
    return j.select(*df.columns, *zs)


# ------------------------------------------------------------------ Gram matrix on executors


def gram_by_cohort(df: DataFrame, vec_col: str, width: int, cohort: Sequence[str] = (),
                   standardize: dict[tuple, tuple[np.ndarray, np.ndarray]] | None = None) -> dict[tuple, np.ndarray]:
    """Sum of outer products z z^T per cohort (partials per partition in NumPy,
    one grouped sum); only the d x d matrices reach the driver."""
    from .moments import gram

    ckeys = list(cohort)
    out: dict[tuple, np.ndarray] = {}
    for r in gram(df, vec_col, width, ckeys, standardize).collect():
        key = _key(r, ckeys)
        m = out.setdefault(key, np.zeros((width, width)))
        m[r["i"], r["j"]] = r["v"]
        m[r["j"], r["i"]] = r["v"]
    return out


# ------------------------------------------------------------------ PCA


@dataclass
class PcaModel:
    """Scaler + PCA parameters per cohort (the persisted "model bundle")."""

    feature_columns: list[str]
    cohort_columns: list[str]
    params: dict[tuple, dict] = field(default_factory=dict)  # key -> n, mean, scale, components (k x d), evr, ev

    def n_components(self, key: tuple = ()) -> int:
        return int(self.params[key]["components"].shape[0])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = []
        for key, p in self.params.items():
            rows.append((json.dumps(list(key), default=str), int(p["n"]), [float(x) for x in p["mean"]], [float(x) for x in p["scale"]],
                         [[float(x) for x in row] for row in p["components"]], [float(x) for x in p["evr"]],
                         [float(x) for x in p["ev"]]))
        schema = ("cohort_key string, n long, mean array<double>, scale array<double>, components array<array<double>>, "
                  "explained_variance_ratio array<double>, explained_variance array<double>")
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("feature_columns", F.lit(json.dumps(self.feature_columns))).withColumn(
            "cohort_columns", F.lit(json.dumps(self.cohort_columns)))

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PcaModel":
        rows = spark.read.parquet(path).collect()
        if not rows:
            raise ValueError(f"empty model at {path}")
        m = cls(json.loads(rows[0]["feature_columns"]), json.loads(rows[0]["cohort_columns"]))
        for r in rows:
            m.params[tuple(json.loads(r["cohort_key"]))] = {
                "n": r["n"], "mean": np.array(r["mean"]), "scale": np.array(r["scale"]),
                "components": np.array(r["components"]), "evr": np.array(r["explained_variance_ratio"]),
                "ev": np.array(r["explained_variance"]),
            }
        return m


def fit_pca(
    df: DataFrame,
    cols: Sequence[str],
    n_components: int,
    cohort: Sequence[str] = (),
    *,
    max_rank_rule: bool = True,
) -> PcaModel:
    """M6 + M7: standardise (population std) then PCA with
    ``min(n_components, d, max(1, n-1))`` components per cohort."""
    cols = list(cols)
    if not cols:
        raise ValueError("No numeric feature columns.")
    st = fit_standardizer(df, cols, cohort)
    model = PcaModel(cols, list(cohort))
    vec = df.select(*cohort, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    grams = gram_by_cohort(vec, "_x", len(cols), cohort, {k: (v["mean"], v["scale"]) for k, v in st.items()})
    d = len(cols)
    for key, s in st.items():
        model.params[key] = _principal(grams.get(key, np.zeros((d, d))), s, n_components, max_rank_rule)
    return model


def _principal(gram: np.ndarray, stats: dict, n_components: int, max_rank_rule: bool = True) -> dict:
    """Leading components of one cohort from the Gram matrix of its standardised rows."""
    n, d = stats["n"], len(gram)
    w, v = np.linalg.eigh(gram / max(n - 1, 1))
    order = np.argsort(w)[::-1]
    w, v = np.clip(w[order], 0.0, None), v[:, order]
    max_rank = min(d, max(1, n - 1)) if max_rank_rule else d
    k = min(int(n_components), max_rank)
    if k < 1:
        raise ValueError(f"Cannot run PCA: n_components={n_components}, max_rank={max_rank}")
    comps = v[:, :k].T.copy()
    for r in range(k):  # deterministic sign: largest-magnitude loading positive
        if comps[r, np.argmax(np.abs(comps[r]))] < 0:
            comps[r] *= -1
    total = float(np.sum(w))
    evr = w[:k] / total if total > 0 else np.zeros(k)
    return {"n": n, "mean": stats["mean"], "scale": stats["scale"], "components": comps, "evr": evr, "ev": w[:k]}


# ------------------------------------------------------------------ many cohorts, each with features of its own


def stacked(frames: dict[tuple, DataFrame], features: dict[tuple, Sequence[str]], cohort: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows of all frames: cohort columns, those of ``keep`` that exist, and ``_f``, the frame's own features.

    ``_f`` has one width for all: a shorter one ends in zeros, and the last element is always one of them."""
    width, out = 1 + max(len(features[key]) for key in frames), None
    for key, df in frames.items():
        values = [F.col(c).cast("double") for c in features[key]]
        vector = F.array(*values, *[F.lit(0.0)] * (width - len(values))).alias("_f")
        part = df.select(*[F.lit(v).alias(c) for c, v in zip(cohort, key)], *[c for c in keep if c in df.columns and c not in cohort], vector)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stacked_moments(rows: DataFrame, features: dict[tuple, Sequence[str]], cohort: Sequence[str]) -> dict[tuple, dict]:
    """Per cohort of ``stacked`` rows: n, count of present values, mean and scale of its own features (two passes for all)."""
    from .moments import column_moments

    width, out = 1 + max(len(f) for f in features.values()), {}
    for key, m in column_moments(rows, "_f", width, cohort).items():
        d = len(features[key])
        scale = np.where((m["std"] > 0) & np.isfinite(m["std"]), m["std"], 1.0)
        out[key] = {"n": int(m["count"][-1]), "count": m["count"][:d], "mean": m["mean"][:d], "scale": scale[:d]}
    return out


def fit_pca_stacked(rows: DataFrame, features: dict[tuple, Sequence[str]], n_components: dict[tuple, int], moments: dict[tuple, dict], cohort: Sequence[str]) -> dict[tuple, PcaModel]:
    """A model per cohort of ``stacked`` rows without missing values, all from one pass; equal to ``fit_pca`` of each alone."""
    width = len(rows.select("_f").first()[0])
    padded = {key: (np.pad(m["mean"], (0, width - len(m["mean"]))), np.pad(m["scale"], (0, width - len(m["scale"])), constant_values=1.0)) for key, m in moments.items()}
    models = {}
    for key, whole in gram_by_cohort(rows, "_f", width, cohort, padded).items():
        d = len(features[key])
        models[key] = PcaModel(list(features[key]), [], {(): _principal(whole[:d, :d], moments[key], n_components[key])})
    return models


def transform_stacked(rows: DataFrame, models: dict[tuple, PcaModel], cohort: Sequence[str], out_col: str = "_pca") -> DataFrame:
    """``stacked`` rows with their projection by the model of their cohort (row-parallel)."""
    ck, schema = list(cohort), T.StructType([*rows.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    params = {key: tuple(m.params[()][p] for p in ("mean", "scale", "components")) for key, m in models.items()}

    def run(batches):
        for pdf in batches:
            out = [None] * len(pdf)
            for key, at in pdf.groupby(ck, sort=False, dropna=False).indices.items() if len(pdf) else ():
                mean, scale, components = params[key]
                x = np.vstack(pdf["_f"].to_numpy()[at]).astype(float)[:, : len(mean)]
                for i, row in zip(at, (x - mean) / scale @ components.T):
                    out[i] = row
            yield pdf.assign(**{out_col: out})

    return rows.mapInPandas(run, schema)


def transform(df: DataFrame, model: PcaModel, out_col: str = "pca") -> DataFrame:
    """Project rows with a fitted scaler + PCA. Missing feature columns raise;
    NULL features raise at the caller's ``assert_no_missing``."""
    missing = [c for c in model.feature_columns if c not in df.columns]
    if missing:
        raise ValueError(f"frame missing {len(missing)} model feature column(s), e.g. {missing[:8]!r}")
    return _apply(df, model, out_col, project=True)


def _apply(df: DataFrame, model: PcaModel, out_col: str, project: bool) -> DataFrame:
    """Row-parallel NumPy projection over Arrow batches (no shuffle). The scaler and
    loadings (d x k per cohort, bounded) travel in the closure: as literals in
    generated code they would force a fresh compile for every fitted model."""
    cols = list(model.feature_columns)
    ck = list(model.cohort_columns)
    params = {key: (np.asarray(p["mean"], float), np.asarray(p["scale"], float),
                    np.asarray(p["components"], float) if project else None) for key, p in model.params.items()}
    inner = df.select("*", F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out_col}` array<double>"])
    keep = df.columns

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            res = [None] * len(pdf)
            groups = pdf.groupby(ck, sort=False, dropna=False).indices.items() if ck else [((), np.arange(len(pdf)))]
            xs = pdf["_x"].to_numpy()
            for key, idx in groups:
                key = key if isinstance(key, tuple) else (key,)
                if key not in params:
                    continue
                mean, scale, comps = params[key]
                x = np.vstack([xs[i] for i in idx]).astype(float)
                z = (x - mean) / scale
                out = z @ comps.T if comps is not None else z
                for j, i in enumerate(idx):
                    res[i] = out[j]
            out_pdf = pdf[keep].copy()
            out_pdf[out_col] = res
            yield out_pdf

    out = inner.mapInPandas(run, schema)
    if ck:  # rows of cohorts without a model are dropped (as an inner join would)
        out = out.where(F.col(out_col).isNotNull())
    return out


def explained_variance_table(spark: SparkSession, model: PcaModel) -> DataFrame:
    """M7/M8 + W3: (cohort..., component, ratio, cumulative) as a DataFrame."""
    from pyspark.sql import Window

    rows = []
    for key, p in model.params.items():
        for i, r in enumerate(p["evr"]):
            rows.append((*[str(x) for x in key], i + 1, float(r)))
    ck = model.cohort_columns
    schema = ", ".join([f"{c} string" for c in ck] + ["component int", "explained_variance_ratio double"])
    w = Window.partitionBy(*ck).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return spark.createDataFrame(rows, schema).withColumn(
        "cumulative_explained_variance", F.sum("explained_variance_ratio").over(w))
