"""Gaussian mixtures by distributed EM (M9, M10, M13) and K-means helpers.

Covariance types: full, tied, diag, spherical. All cohorts and all restarts
(``n_init``) advance together: one Spark job per EM iteration.

* E-step on executors: ``mapInPandas`` groups each Arrow batch by
  (cohort, restart), computes log densities / responsibilities with NumPy and
  emits the partition's sufficient statistics (N_k, sum r*x, sum r*x x^T or
  sum r*x^2, log-likelihood) as (key, slot, value) rows.
* Reduce: one grouped ``sum`` -- the only data reaching the driver is
  k*(1+d+d^2) numbers per cohort and restart.
* M-step on the driver (tiny matrices), regularised by ``reg_covar`` on the
  diagonal. Stop when the mean log-likelihood changes by less than ``tol``.
* Initialisation: K-means -- k-means|| seeding over all rows, refined by Lloyd
  iterations run jointly in the same machinery -- then the
  M-step of the hard K-means responsibilities (plain sampled means are an option).
  Several k can be fitted in the same jobs.

The input is checkpointed into ``spark.checkpoint.dir`` first, so iterations
re-read a short lineage and survive executor loss.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COVARIANCE_TYPES = ("full", "tied", "diag", "spherical")
LOG_2PI = math.log(2 * math.pi)


@dataclass
class Mixture:
    covariance_type: str
    weights: np.ndarray  # (k,)
    means: np.ndarray  # (k, d)
    covariances: np.ndarray  # full (k,d,d) | tied (d,d) | diag (k,d) | spherical (k,)
    lower_bound: float = float("-inf")
    n_iter: int = 0
    converged: bool = False

    @property
    def k(self) -> int:
        return int(self.means.shape[0])

    @property
    def d(self) -> int:
        return int(self.means.shape[1])

    def n_parameters(self) -> int:
        k, d = self.k, self.d
        cov = {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d, "spherical": k}[self.covariance_type]
        return int(cov + k * d + k - 1)

    def log_weighted(self, x: np.ndarray) -> np.ndarray:
        """(n, k) log w_k + log N(x | mu_k, Sigma_k)."""
        k, d = self.k, self.d
        out = np.empty((x.shape[0], k))
        t = self.covariance_type
        for j in range(k):
            diff = x - self.means[j]
            if t in ("full", "tied"):
                cov = self.covariances[j] if t == "full" else self.covariances
                chol = np.linalg.cholesky(cov)
                y = np.linalg.solve(chol, diff.T).T
                logdet = 2.0 * np.sum(np.log(np.diag(chol)))
                maha = np.einsum("ij,ij->i", y, y)
            elif t == "diag":
                var = self.covariances[j]
                logdet = float(np.sum(np.log(var)))
                maha = np.sum(diff * diff / var, axis=1)
            else:
                var = float(self.covariances[j])
                logdet = d * math.log(var)
                maha = np.sum(diff * diff, axis=1) / var
            out[:, j] = -0.5 * (d * LOG_2PI + logdet + maha) + math.log(max(self.weights[j], 1e-300))
        return out


def save_mixtures(spark, path: str, models: dict[tuple, Mixture], cohort: Sequence[str] = ()) -> None:
    """Parameter table (one row per cohort) written as Parquet (the model sink)."""
    import json

    rows = [(json.dumps(list(key), default=str), m.covariance_type, [float(w) for w in m.weights],
             [[float(v) for v in row] for row in m.means], [float(v) for v in np.ravel(m.covariances)],
             [int(v) for v in np.shape(m.covariances)], float(m.lower_bound), int(m.n_iter), bool(m.converged))
            for key, m in models.items()]
    schema = ("cohort_key string, covariance_type string, weights array<double>, means array<array<double>>, "
              "covariances array<double>, covariance_shape array<int>, lower_bound double, n_iter int, converged boolean")
    df = spark.createDataFrame(rows, schema).withColumn("cohort_columns", F.lit(json.dumps(list(cohort))))
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_mixtures(spark, path: str) -> dict[tuple, Mixture]:
    """Model source: the parameter table back into ``Mixture`` objects."""
    import json

    out = {}
    for r in spark.read.parquet(path).collect():
        cov = np.array(r["covariances"], dtype=float).reshape(tuple(r["covariance_shape"]))
        out[tuple(json.loads(r["cohort_key"]))] = Mixture(r["covariance_type"], np.array(r["weights"]), np.array(r["means"]),
                                                           cov, r["lower_bound"], r["n_iter"], r["converged"])
    return out


def _logsumexp(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=1, keepdims=True)))[:, 0]


def _stats_width(k: int, d: int, cov: str) -> int:
    second = d * d if cov in ("full", "tied") else d
    return k * (1 + d + second) + 1


def _m_step(stats: np.ndarray, k: int, d: int, n: int, cov: str, reg: float) -> Mixture:
    second = d * d if cov in ("full", "tied") else d
    nk = stats[:k] + 10 * np.finfo(float).eps
    s1 = stats[k:k + k * d].reshape(k, d)
    s2 = stats[k + k * d:k + k * d + k * second].reshape((k, d, d) if second == d * d else (k, d))
    means = s1 / nk[:, None]
    if cov == "full":
        covs = s2 / nk[:, None, None] - np.einsum("ki,kj->kij", means, means)
        covs = 0.5 * (covs + covs.transpose(0, 2, 1)) + reg * np.eye(d)[None]
    elif cov == "tied":
        covs = (s2.sum(axis=0) - np.einsum("k,ki,kj->ij", nk, means, means)) / nk.sum()
        covs = 0.5 * (covs + covs.T) + reg * np.eye(d)
    elif cov == "diag":
        covs = np.maximum(s2 / nk[:, None] - means ** 2, 0.0) + reg
    else:
        covs = (np.maximum(s2 / nk[:, None] - means ** 2, 0.0) + reg).mean(axis=1)
    return Mixture(cov, nk / n, means, covs)


@dataclass
class _Run:
    model: Mixture
    prev_lb: float = float("-inf")
    active: bool = True
    history: list[float] = field(default_factory=list)


def _prepare(df: DataFrame, vec_col: str, cohort: Sequence[str], checkpoint: bool, what: str) -> tuple[DataFrame, dict[tuple, np.ndarray]]:
    """(rows relative to the mean of their cohort, those means).

    Second moments about a far origin would lose their digits, so every fit runs
    about the mean and its centres are moved back at the end (``_moved``)."""
    ck = list(cohort)
    base = df.select(*ck, F.col(vec_col).cast("array<double>").alias("_x"))
    if checkpoint:
        from ..session import cut_lineage

        base = cut_lineage(base)
    first = base.select(F.size("_x")).first()
    if first is None:
        raise ValueError(f"Empty dataframe for {what}.")
    from .moments import column_moments

    origins = {key: m["mean"] for key, m in column_moments(base, "_x", int(first[0]), ck).items()}

    def shifted(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(ck, sort=False, dropna=False).indices.items() if ck else [((), np.arange(len(pdf)))]
            rows = pdf["_x"].to_numpy().copy()
            for key, at in groups:
                x = np.vstack(rows[at]).astype(float) - origins[key if isinstance(key, tuple) else (key,)]
                for i, row in zip(at, x):
                    rows[i] = row
            yield pdf.assign(_x=rows)

    # re-read every iteration: keep it in memory too (the checkpoint stays the
    # recovery copy if an executor holding cached blocks is lost)
    return base.mapInPandas(shifted, base.schema).persist(), origins


def _seed_rows(base: DataFrame, ck, m: int, seed: int) -> dict[tuple, np.ndarray]:
    """Per cohort the ``m`` rows with the smallest seeded hash (a deterministic
    random sample). With cohorts, ``row_number() <= m`` is planned with a
    partial group limit before the shuffle; without, a top-k ``limit``."""
    h = base.withColumn("_h", F.xxhash64(F.col("_x"), F.lit(seed)))
    if ck:
        w = Window.partitionBy(*ck).orderBy(F.col("_h"), F.col("_x").cast("string"))
        picked = h.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= m).orderBy(*ck, "_rn").collect()
    else:
        picked = h.orderBy(F.col("_h"), F.col("_x").cast("string")).limit(m).collect()
    out: dict[tuple, list] = {}
    for r in picked:
        out.setdefault(tuple(r[c] for c in ck), []).append(r["_x"])
    return {key: np.array(v, dtype=float) for key, v in out.items()}


def _kmeans_pp(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, iters: int = 20) -> np.ndarray:
    """k-means++ and a few Lloyd steps over weighted points (the k-means|| candidates)."""
    centers = [points[rng.choice(len(points), p=weights / weights.sum())]]
    d2 = ((points - centers[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        mass = d2 * weights
        idx = rng.choice(len(points), p=mass / mass.sum()) if mass.sum() > 0 else rng.integers(len(points))
        centers.append(points[idx])
        d2 = np.minimum(d2, ((points - points[idx]) ** 2).sum(axis=1))
    c = np.array(centers, dtype=float)
    for _ in range(iters):
        lab = ((points[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(k):
            own = weights * (lab == j)
            if own.sum() > 0:
                c[j] = own @ points / own.sum()
    return c


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number for each row hash and salt (a 64-bit mix)."""
    z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def _seeds(base: DataFrame, ck, d: int, k: int, restarts: int, seed: int, rounds: int = 3) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """k-means||: per (cohort, restart) candidate points from all rows, weighted by the rows nearest to them.

    Each round draws every row with a probability in proportion to its squared
    distance from the candidates so far (about ``2 k`` rows a round); equal rows
    are drawn together and kept once."""
    hashed = base.withColumn("_h", F.xxhash64("_x"))
    starts = [F.min_by("_x", F.xxhash64("_x", F.lit(seed + r))).alias(f"s{r}") for r in range(restarts)]
    points: dict[tuple, list] = {}
    for row in (hashed.groupBy(*ck).agg(*starts) if ck else hashed.agg(*starts)).collect():
        for r in range(restarts):
            points[tuple(row[c] for c in ck), r] = [row[f"s{r}"]]
    schema = ", ".join([f"{c} {base.schema[c].dataType.simpleString()}" for c in ck] + ["_r int", "_x array<double>"])

    def costs() -> dict[tuple, tuple[np.ndarray, int]]:
        runs = {key: _Run(Mixture("spherical", np.ones(len(c)), np.array(c, dtype=float), np.ones(len(c)))) for key, c in points.items()}
        return _collect_stats(base, ck, runs, d, "spherical", hard_centers=True)

    for step in range(rounds):
        centres = {key: np.array(c, dtype=float) for key, c in points.items()}
        share = {key: 2.0 * k / vec[-1] for key, (vec, _) in costs().items() if vec[-1] > 0}

        def draw(batches, centres=centres, share=share, step=step):
            import pandas as pd

            for pdf in batches:
                groups = pdf.groupby(ck, sort=False, dropna=False) if ck else [((), pdf)]
                for key, g in groups if len(pdf) else ():
                    key = key if isinstance(key, tuple) else (key,)
                    x = np.vstack(g["_x"].to_numpy()).astype(float)
                    for r in range(restarts):
                        if (key, r) not in share:
                            continue
                        d2 = np.full(len(x), np.inf)
                        for c in centres[key, r]:
                            d2 = np.minimum(d2, ((x - c) ** 2).sum(axis=1))
                        drawn = _uniform(g["_h"].to_numpy(), (seed + r) * 64 + step) < share[key, r] * d2
                        picked = np.unique(x[drawn], axis=0)
                        if len(picked):
                            data = {c: pd.Series([key[i]]).repeat(len(picked)) for i, c in enumerate(ck)}
                            yield pd.DataFrame({**{c: v.to_numpy() for c, v in data.items()}, "_r": np.int32(r), "_x": list(picked)})

        for row in hashed.mapInPandas(draw, schema).distinct().collect():
            points[tuple(row[c] for c in ck), int(row["_r"])].append(row["_x"])
    weights = costs()
    # the order of rows is not fixed, that of the candidates is
    out = {}
    for key, c in points.items():
        order = np.lexsort(np.array(c, dtype=float).T[::-1])
        out[key] = (np.array(c, dtype=float)[order], np.maximum(weights[key][0][: len(c)][order], 1e-9))
    return out


def _lloyd(base: DataFrame, ck, runs: dict[tuple, _Run], d: int, max_iter: int, tol: float = 1e-4) -> dict[tuple, float]:
    """Joint Lloyd iterations for every run (one job per iteration). A run stops
    when its total squared centre shift is at most ``tol`` times the mean
    per-feature variance of its cohort. Returns the inertia of the final centres."""
    inertia: dict[tuple, float] = {}
    var_mean: dict[tuple, float] = {}
    for _ in range(max_iter + 1):
        if not any(r.active for r in runs.values()):
            break
        stats = _collect_stats(base, ck, runs, d, "spherical", hard_centers=True)
        for kk, (vec, n) in stats.items():
            run = runs[kk]
            k = run.model.k
            nk = vec[:k]
            s1 = vec[k:k + k * d].reshape(k, d)
            if kk not in var_mean:
                s2 = vec[k + k * d:k + 2 * k * d].reshape(k, d)
                mu = s1.sum(axis=0) / n
                var_mean[kk] = float(np.mean(s2.sum(axis=0) / n - mu ** 2))
            inertia[kk] = float(vec[-1])
            new = np.where(nk[:, None] > 0, s1 / np.maximum(nk, 1)[:, None], run.model.means)
            shift = float(((new - run.model.means) ** 2).sum())
            run.model.means = new
            if shift <= tol * max(var_mean[kk], 0.0):
                run.active = False
    for run in runs.values():
        run.active = True
    return inertia


def _collect_stats(base: DataFrame, ck, runs: dict[tuple, _Run], d: int, cov: str, hard_centers: bool):
    """One distributed pass over the data for every active run: per (cohort, run)
    summed sufficient statistics. Runs may differ in k."""
    snapshot = {key: run.model for key, run in runs.items() if run.active}
    by_cohort: dict[tuple, list[tuple[int, Mixture]]] = {}
    for (ckey, run_id), m in snapshot.items():
        by_cohort.setdefault(ckey, []).append((run_id, m))
    schema = ", ".join([f"{c} {base.schema[c].dataType.simpleString()}" for c in ck] + ["_r int", "_j int", "_v double", "_n long"])
    second_full = cov in ("full", "tied")

    def estep(batches):
        import pandas as pd

        acc: dict[tuple, np.ndarray] = {}
        cnt: dict[tuple, int] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(ck, sort=False, dropna=False) if ck else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                models = by_cohort.get(key)
                if not models:
                    continue
                x = np.vstack(g["_x"].to_numpy()).astype(float)
                for run_id, m in models:
                    k = m.k
                    width = _stats_width(k, d, cov)
                    if hard_centers:  # K-means responsibilities: nearest centre, one-hot
                        dist = ((x[:, None, :] - m.means[None, :, :]) ** 2).sum(axis=2)
                        resp = np.zeros((x.shape[0], k))
                        resp[np.arange(x.shape[0]), dist.argmin(axis=1)] = 1.0
                        ll = float(dist.min(axis=1).sum())  # inertia
                    else:
                        lw = m.log_weighted(x)
                        norm = _logsumexp(lw)
                        resp = np.exp(lw - norm[:, None])
                        ll = float(norm.sum())
                    vec = np.empty(width)
                    vec[:k] = resp.sum(axis=0)
                    vec[k:k + k * d] = (resp.T @ x).ravel()
                    if second_full:
                        s2 = np.einsum("nk,ni,nj->kij", resp, x, x)
                    else:
                        s2 = resp.T @ (x * x)
                    vec[k + k * d:width - 1] = s2.ravel()
                    vec[width - 1] = ll
                    kk = (*key, run_id)
                    acc[kk] = acc[kk] + vec if kk in acc else vec
                    cnt[kk] = cnt.get(kk, 0) + x.shape[0]
        for kk, vec in acc.items():
            width = len(vec)
            data = {c: [kk[i]] * width for i, c in enumerate(ck)}
            data.update({"_r": [kk[-1]] * width, "_j": np.arange(width, dtype="int32"), "_v": vec,
                         "_n": [cnt[kk]] + [0] * (width - 1)})
            yield pd.DataFrame(data)

    partials = base.mapInPandas(estep, schema)
    rows = partials.groupBy(*ck, "_r", "_j").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n")).collect()
    out: dict[tuple, tuple[np.ndarray, int]] = {}
    for r in rows:
        kk = (tuple(r[c] for c in ck), int(r["_r"]))
        width = _stats_width(snapshot[kk].k, d, cov)
        vec, n = out.get(kk, (np.zeros(width), 0))
        vec[int(r["_j"])] += r["_v"]
        out[kk] = (vec, n + int(r["_n"]))
    return out


def fit_mixtures(
    df: DataFrame,
    vec_col: str,
    ks: Sequence[int],
    *,
    covariance_type: str = "full",
    cohort: Sequence[str] = (),
    n_init: int = 1,
    seed: int = 42,
    tol: float = 1e-3,
    max_iter: int = 100,
    reg_covar: float = 1e-6,
    init: str = "kmeans",
    kmeans_max_iter: int = 100,
    checkpoint: bool = True,
) -> dict[tuple, Mixture]:
    """Best-of-``n_init`` mixture per (cohort, k) for several k at once.

    Every (cohort, k, restart) run advances in the same Spark job per
    iteration, so a sweep over k costs about as many jobs as its slowest run.
    ``init``: ``kmeans`` (default; k-means|| seeding and Lloyd iterations over all
    rows, run jointly in the same machinery, then the initial M-step from the hard
    K-means responsibilities) or ``random_from_data`` (the sampled rows as means)."""
    if covariance_type not in COVARIANCE_TYPES:
        raise ValueError(f"covariance_type must be one of {sorted(COVARIANCE_TYPES)}; got {covariance_type!r}")
    if init not in ("kmeans", "random_from_data"):
        raise ValueError(f"init must be kmeans or random_from_data; got {init!r}")
    ks = [int(k) for k in ks]
    if not ks or min(ks) < 1:
        raise ValueError("k must be >= 1")
    ck = list(cohort)
    base, origins = _prepare(df, vec_col, ck, checkpoint, "mixture fitting")
    d = len(next(iter(origins.values())))
    sizes = {tuple(r[c] for c in ck): int(r["_n"]) for r in (
        base.groupBy(*ck).agg(F.count(F.lit(1)).alias("_n")) if ck else base.agg(F.count(F.lit(1)).alias("_n"))).collect()}
    for key, n in sizes.items():
        if max(ks) > n:
            raise ValueError(f"n_clusters ({max(ks)}) cannot exceed n_samples ({n}) for cohort {key}")

    runs: dict[tuple, _Run] = {}
    run_k: dict[int, int] = {}
    seeds = _seeds(base, ck, d, max(ks), n_init, seed) if init == "kmeans" else {}
    for restart in range(n_init):
        if init == "random_from_data":
            drawn = {key: (rows, None) for key, rows in _seed_rows(base, ck, max(ks), seed + restart).items()}
        else:
            drawn = {key: found for (key, r), found in seeds.items() if r == restart}
        for k in ks:
            rid = len(run_k)
            run_k[rid] = k
            for key, (rows, weights) in drawn.items():
                centres = rows[:k].copy() if weights is None else _kmeans_pp(rows, weights, k, np.random.default_rng(seed + restart))
                runs[(key, rid)] = _Run(Mixture(covariance_type, np.full(k, 1.0 / k), centres, np.zeros(1)))
    if init == "kmeans":  # joint Lloyd iterations
        _lloyd(base, ck, runs, d, kmeans_max_iter)
    # initial M-step from hard K-means responsibilities
    stats = _collect_stats(base, ck, runs, d, covariance_type, hard_centers=True)
    for kk, (vec, n) in stats.items():
        runs[kk].model = _m_step(vec, runs[kk].model.k, d, n, covariance_type, reg_covar)

    for it in range(1, max_iter + 1):
        if not any(r.active for r in runs.values()):
            break
        stats = _collect_stats(base, ck, runs, d, covariance_type, hard_centers=False)
        for kk, (vec, n) in stats.items():
            run = runs[kk]
            lb = vec[-1] / n
            run.model = _m_step(vec, run.model.k, d, n, covariance_type, reg_covar)
            run.model.lower_bound = lb
            run.model.n_iter = it
            run.history.append(lb)
            if abs(lb - run.prev_lb) < tol:
                run.active = False
                run.model.converged = True
            run.prev_lb = lb
    base.unpersist()
    best: dict[tuple, Mixture] = {}
    for (key, rid), run in sorted(runs.items(), key=lambda kv: kv[0][1]):
        bk = (key, run_k[rid])
        if bk not in best or run.model.lower_bound > best[bk].lower_bound:
            best[bk] = run.model
    slow = sorted({bk for bk, m in best.items() if not m.converged}, key=str)
    if slow:
        warnings.warn(f"not converged within {max_iter} iterations: {slow}", stacklevel=2)
    for (key, _), m in best.items():
        m.means = m.means + origins[key]
    return best


def fit_mixture(df: DataFrame, vec_col: str, k: int, **kwargs) -> dict[tuple, Mixture]:
    """Best-of-``n_init`` mixture per cohort for one k (see ``fit_mixtures``)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    return {key: m for (key, _k), m in fit_mixtures(df, vec_col, [k], **kwargs).items()}


def fit_from(
    df: DataFrame,
    vec_col: str,
    start: dict[tuple, Mixture],
    passes: int,
    *,
    cohort: Sequence[str] = (),
    reg_covar: float = 1e-6,
    checkpoint: bool = True,
) -> DataFrame:
    """EM from given parameters for a given number of passes, as rows.

    (cohort..., step, component, weight, mean, covariance, mean_log_likelihood): step 0 is the start, step s the
    parameters after s passes; the likelihood is that of the row's own parameters. ``covariance`` is flat: d x d
    numbers for full and tied, d for diag, one for spherical. Nothing is drawn, so a fit can be continued from a
    saved model and followed step by step. One job a pass for all cohorts; cohorts without a start are left out."""
    if passes < 0:
        raise ValueError(f"passes must be 0 or more; got {passes}")
    kinds = {m.covariance_type for m in start.values()}
    if len(kinds) != 1:
        raise ValueError(f"one covariance type for all cohorts; got {sorted(kinds)}")
    kind, ck = kinds.pop(), list(cohort)
    base, origins = _prepare(df, vec_col, ck, checkpoint, "mixture fitting")
    keys = [key for key in start if key in origins]
    d = len(next(iter(origins.values())))
    runs = {(key, 0): _Run(Mixture(kind, start[key].weights, start[key].means - origins[key], start[key].covariances)) for key in keys}
    rows = []
    for step in range(passes + 1):
        stats = _collect_stats(base, ck, runs, d, kind, hard_centers=False)
        for (key, rid), (vec, n) in stats.items():
            m = runs[key, rid].model
            for j in range(m.k):
                c = m.covariances if kind == "tied" else m.covariances[j]
                rows.append((*key, step, j, float(m.weights[j]), [float(v) for v in m.means[j] + origins[key]],
                             [float(v) for v in np.ravel(c)], float(vec[-1] / n)))
            runs[key, rid].model = _m_step(vec, m.k, d, n, kind, reg_covar)
    base.unpersist()
    names = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in ck)
    return df.sparkSession.createDataFrame(
        rows, f"{names}step int, component int, weight double, mean array<double>, covariance array<double>, mean_log_likelihood double")


def score(df: DataFrame, vec_col: str, models: dict[tuple, Mixture], cohort: Sequence[str] = ()) -> DataFrame:
    """(cohort..., n, mean_log_likelihood, aic, bic) under the final parameters (one pass)."""
    ck = list(cohort)
    base = df.select(*ck, F.col(vec_col).cast("array<double>").alias("_x"))
    schema = ", ".join([f"{c} {base.schema[c].dataType.simpleString()}" for c in ck] + ["_ll double", "_n long"])

    def ll(batches):
        import pandas as pd

        acc: dict[tuple, list] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(ck, sort=False, dropna=False) if ck else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                m = models.get(key)
                if m is None:
                    continue
                x = np.vstack(g["_x"].to_numpy()).astype(float)
                s = float(_logsumexp(m.log_weighted(x)).sum())
                a = acc.setdefault(key, [0.0, 0])
                a[0] += s
                a[1] += x.shape[0]
        if acc:
            data = {c: [key[i] for key in acc] for i, c in enumerate(ck)}
            data.update({"_ll": [v[0] for v in acc.values()], "_n": [v[1] for v in acc.values()]})
            yield pd.DataFrame(data)

    agg = base.mapInPandas(ll, schema).groupBy(*ck).agg(F.sum("_ll").alias("_ll"), F.sum("_n").alias("n"))
    rows = agg.collect()
    out = []
    for r in rows:
        key = tuple(r[c] for c in ck)
        m = models[key]
        n, tot = int(r["n"]), float(r["_ll"])
        p = m.n_parameters()
        out.append((*key, n, tot / n, -2 * tot + 2 * p, -2 * tot + p * math.log(n), float(m.lower_bound), int(m.n_iter), bool(m.converged)))
    types = [f"{c} {base.schema[c].dataType.simpleString()}" for c in ck]
    schema2 = ", ".join(types + ["n long", "mean_log_likelihood double", "aic double", "bic double", "lower_bound double",
                                 "n_iter int", "converged boolean"])
    return df.sparkSession.createDataFrame(out, schema2)


def _labelled(df: DataFrame, vec_col: str, models: dict[str, dict], cohort: Sequence[str], label) -> DataFrame:
    """``df`` with a label column for each of ``models`` ({column: {cohort: model}}), all in one pass: one Python worker
    a task, however many models there are."""
    ck = list(cohort)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{c} long" for c in models])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.copy()
            found = {c: np.zeros(len(pdf), dtype=np.int64) for c in models}
            groups = pdf.groupby(ck, sort=False, dropna=False).indices.items() if ck else [((), np.arange(len(pdf)))]
            for key, idx in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.vstack(pdf[vec_col].to_numpy()[idx]).astype(float)
                for c, by_cohort in models.items():
                    found[c][idx] = label(by_cohort[key], x)
            yield pdf.assign(**found)

    return df.mapInPandas(run, schema)


def predict_all(df: DataFrame, vec_col: str, models: dict[str, dict[tuple, Mixture]], cohort: Sequence[str] = ()) -> DataFrame:
    """:func:`predict` for several sets of models ({label column: models}) in one pass."""
    return _labelled(df, vec_col, models, cohort, lambda m, x: m.log_weighted(x).argmax(axis=1))


def predict(df: DataFrame, vec_col: str, models: dict[tuple, Mixture], cohort: Sequence[str] = (), out_col: str = "cluster_id") -> DataFrame:
    """Most probable component per row (row-parallel, no shuffle)."""
    return predict_all(df, vec_col, {out_col: models}, cohort)


# ------------------------------------------------------------------ K-means


def fit_kmeans(
    df: DataFrame,
    vec_col: str,
    ks: Sequence[int],
    *,
    cohort: Sequence[str] = (),
    n_init: int = 1,
    seed: int = 42,
    max_iter: int = 300,
    checkpoint: bool = True,
) -> dict[tuple, tuple[np.ndarray, float]]:
    """K-means for several k (and cohorts, restarts) in the same jobs: k-means||
    seeding, then joint Lloyd iterations, all over all rows.
    Returns {(cohort_key, k): (centres, inertia)} keeping the lowest inertia."""
    ks = [int(k) for k in ks]
    ck = list(cohort)
    base, origins = _prepare(df, vec_col, ck, checkpoint, "K-means")
    d = len(next(iter(origins.values())))
    runs: dict[tuple, _Run] = {}
    run_k: dict[int, int] = {}
    seeds = _seeds(base, ck, d, max(ks), n_init, seed)
    for restart in range(n_init):
        for k in ks:
            rid = len(run_k)
            run_k[rid] = k
            for key, (rows, weights) in ((key, found) for (key, r), found in seeds.items() if r == restart):
                c = _kmeans_pp(rows, weights, k, np.random.default_rng(seed + restart))
                runs[(key, rid)] = _Run(Mixture("spherical", np.full(k, 1.0 / k), c, np.ones(k)))
    _lloyd(base, ck, runs, d, max_iter)
    final = _collect_stats(base, ck, runs, d, "spherical", hard_centers=True)
    inertia = {kk: float(vec[-1]) for kk, (vec, _n) in final.items()}
    base.unpersist()
    best: dict[tuple, tuple[np.ndarray, float]] = {}
    for (key, rid), run in sorted(runs.items(), key=lambda kv: kv[0][1]):
        bk = (key, run_k[rid])
        val = inertia.get((key, rid), float("inf"))
        if bk not in best or val < best[bk][1]:
            best[bk] = (run.model.means + origins[key], val)
    return best


def assign_nearest_all(df: DataFrame, vec_col: str, centres: dict[str, dict[tuple, np.ndarray]], cohort: Sequence[str] = ()) -> DataFrame:
    """:func:`assign_nearest` for several sets of centres ({label column: centres}) in one pass."""
    return _labelled(df, vec_col, centres, cohort, lambda c, x: ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1))


def assign_nearest(df: DataFrame, vec_col: str, centres: dict[tuple, np.ndarray], cohort: Sequence[str] = (),
                   out_col: str = "cluster_id") -> DataFrame:
    """Nearest centre per row (row-parallel, no shuffle)."""
    return assign_nearest_all(df, vec_col, {out_col: centres}, cohort)
