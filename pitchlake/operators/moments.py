"""Second-moment matrices reduced on executors.

Wide covariance / correlation work as one SQL aggregate needs d(d-1)/2
expressions (1,485 for 55 columns): the plan alone takes tens of seconds to
build and compile. Instead each partition computes its partial moment matrices
with NumPy inside ``mapInPandas`` (grouped by cohort within the Arrow batch) and
emits them as (cohort..., i, j, stat values) rows; one grouped ``sum`` merges
the partials. The data volume is O(partitions x cohorts x d^2), independent
of the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _groups(pdf, ck):
    if not ck:
        return [((), pdf)]
    out = []
    for key, g in pdf.groupby(ck, sort=False, dropna=False):
        out.append((key if isinstance(key, tuple) else (key,), g))
    return out


def _matrix(g, vec_col: str, width: int) -> np.ndarray:
    vals = g[vec_col].to_numpy()
    x = np.full((len(vals), width), np.nan)
    for r, v in enumerate(vals):
        if v is not None:
            x[r] = np.array([np.nan if e is None else e for e in v], dtype=float)
    return x


def pairwise_moments(df: DataFrame, vec_col: str, width: int, cohort: Sequence[str] = (),
                     standardize: dict[tuple, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """Pair-complete sums for every pair i < j:
    (cohort..., i, j, n, sx, sy, sxx, syy, sxy), where the sums run over rows in
    which both elements are present (NULL / NaN elements are missing). With
    ``standardize`` ({cohort: (mean, scale)}) values are standardised first
    (Pearson r is unchanged; the sums stay well conditioned)."""
    ck = list(cohort)
    schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in ck]
                       + ["i int", "j int", "n double", "sx double", "sy double", "sxx double", "syy double", "sxy double"])
    iu, ju = np.triu_indices(width, k=1)

    def partial(batches):
        import pandas as pd

        acc: dict[tuple, list[np.ndarray]] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for key, g in _groups(pdf, ck):
                x = _matrix(g, vec_col, width)
                if standardize is not None:
                    mean, scale = standardize[key]
                    x = (x - mean) / scale
                m = (~np.isnan(x)).astype(float)
                z = np.where(m > 0, x, 0.0)
                mats = [m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z]  # N, Sx[i|j], Sxx[i|j], Sxy
                if key in acc:
                    acc[key] = [a + b for a, b in zip(acc[key], mats)]
                else:
                    acc[key] = mats
        for key, (nn, sx, sxx, sxy) in acc.items():
            data = {c: [key[t]] * len(iu) for t, c in enumerate(ck)}
            data.update({"i": iu.astype("int32"), "j": ju.astype("int32"), "n": nn[iu, ju],
                         "sx": sx[iu, ju], "sy": sx[ju, iu], "sxx": sxx[iu, ju], "syy": sxx[ju, iu], "sxy": sxy[iu, ju]})
            yield pd.DataFrame(data)

    parts = df.select(*ck, vec_col).mapInPandas(partial, schema)
    return parts.groupBy(*ck, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def pearson_from_moments(m: DataFrame) -> DataFrame:
    """Adds ``r`` (NULL when a side has no variance or no complete pairs)."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = n * F.col("sxy") - sx * sy
    vx = n * F.col("sxx") - sx * sx
    vy = n * F.col("syy") - sy * sy
    den = F.sqrt(vx * vy)
    r = F.when((n > 1) & (vx > 0) & (vy > 0) & (den > 0), cov / den)
    # clamp tiny rounding excursions beyond [-1, 1]
    return m.withColumn("r", F.when(r.isNull(), r).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))


def gram(df: DataFrame, vec_col: str, width: int, cohort: Sequence[str] = (),
         standardize: dict[tuple, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """Sum of outer products per cohort, upper triangle incl. diagonal:
    (cohort..., i, j, v, n) -- ``n`` (row count) is carried on the (0, 0) entry only.
    With ``standardize`` ({cohort: (mean, scale)}), rows are standardised in
    NumPy first (parameters travel in the closure, not as generated code)."""
    ck = list(cohort)
    schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in ck] + ["i int", "j int", "v double", "n long"])
    iu, ju = np.triu_indices(width)

    def partial(batches):
        import pandas as pd

        acc: dict[tuple, np.ndarray] = {}
        cnt: dict[tuple, int] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for key, g in _groups(pdf, ck):
                z = np.vstack(g[vec_col].to_numpy()).astype(float)
                if standardize is not None:
                    mean, scale = standardize[key]
                    z = (z - mean) / scale
                acc[key] = acc[key] + z.T @ z if key in acc else z.T @ z
                cnt[key] = cnt.get(key, 0) + z.shape[0]
        for key, mat in acc.items():
            data = {c: [key[t]] * len(iu) for t, c in enumerate(ck)}
            n = np.zeros(len(iu), dtype=np.int64)
            n[0] = cnt[key]
            data.update({"i": iu.astype("int32"), "j": ju.astype("int32"), "v": mat[iu, ju], "n": n})
            yield pd.DataFrame(data)

    parts = df.select(*ck, vec_col).mapInPandas(partial, schema)
    return parts.groupBy(*ck, "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def column_moments(df: DataFrame, vec_col: str, width: int, cohort: Sequence[str] = ()) -> dict[tuple, dict]:
    """Per cohort: n, mean and population std of every vector element (NULL/NaN
    elements skipped), in two NumPy passes -- sums, then squares centred on the
    global means (numerically stable). Only 2 x d numbers per cohort and
    partition leave the executors."""
    ck = list(cohort)
    schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in ck] + ["i int", "n double", "s double"])

    def pass_fn(means):
        def partial(batches):
            import pandas as pd

            acc: dict[tuple, list[np.ndarray]] = {}
            for pdf in batches:
                if pdf.empty:
                    continue
                for key, g in _groups(pdf, ck):
                    x = _matrix(g, vec_col, width)
                    ok = ~np.isnan(x)
                    if means is None:
                        v = np.where(ok, x, 0.0)
                    else:
                        v = np.where(ok, x - means[key], 0.0) ** 2
                    part = [ok.sum(axis=0).astype(float), v.sum(axis=0)]
                    acc[key] = [a + b for a, b in zip(acc[key], part)] if key in acc else part
            for key, (n, ssum) in acc.items():
                data = {c: [key[t]] * width for t, c in enumerate(ck)}
                data.update({"i": np.arange(width, dtype="int32"), "n": n, "s": ssum})
                yield pd.DataFrame(data)
        return partial

    src = df.select(*ck, vec_col)

    def run(means):
        rows = src.mapInPandas(pass_fn(means), schema).groupBy(*ck, "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        out: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for r in rows:
            key = tuple(r[c] for c in ck)
            n, s_ = out.setdefault(key, (np.zeros(width), np.zeros(width)))
            n[r["i"]] = r["n"]
            s_[r["i"]] = r["s"]
        return out

    first = run(None)
    means = {k: np.where(n > 0, s_ / np.maximum(n, 1), np.nan) for k, (n, s_) in first.items()}
    second = run(means)
    res = {}
    for key, (n, ss) in second.items():
        sd = np.sqrt(np.where(n > 0, ss / np.maximum(n, 1), np.nan))
        res[key] = {"n": int(first[key][0].max()), "count": first[key][0], "mean": means[key], "std": sd}
    return res
