"""Model-side operators against NumPy oracles (no scikit-learn available)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import knn as knn_ops
from pitchlake.operators import metrics as mt
from pitchlake.operators import mixture as mx
from pitchlake.operators import scaling as sc
from pitchlake.operators import tuning as tn
from pitchlake.plans.clustering import ClusterSpec, fit_cohort, fit_cohorts, spec_of


def _blobs(n_per=75, centres=4, d=6, seed=42, std=0.6):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-10, 10, size=(centres, d))
    x = np.vstack([ci + rng.normal(0, std, size=(n_per, d)) for ci in c])
    return x, np.repeat(np.arange(centres), n_per)


def _frame(spark, x, labels=None, extra=None):
    d = x.shape[1]
    rows = []
    for i, v in enumerate(x):
        rec = [i, f"P{i:03d}", 2024, "batter", 500] + [float(t) for t in v]
        if labels is not None:
            rec.append(int(labels[i]))
        rows.append(tuple(rec))
    schema = "player_id long, player_name string, year int, role string, n_pitches_total long, " + ", ".join(f"f{j} double" for j in range(d))
    if labels is not None:
        schema += ", label long"
    return spark.createDataFrame(rows, schema)


def test_pca_ratios_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = _frame(spark, x)
    cols = [f"f{j}" for j in range(5)]
    model = sc.fit_pca(df, cols, 3)
    z = (x - x.mean(0)) / x.std(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(model.params[()]["evr"], (ev / ev.sum())[:3], atol=1e-10)
    proj = np.array([r["pca"] for r in sc.transform(df, model, "pca").orderBy("player_id").collect()])
    # distances are invariant to component signs
    ref = z @ np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :3]
    assert np.allclose(np.abs(proj), np.abs(ref), atol=1e-8)


def test_pca_component_cap_and_model_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(3, 6))
    df = _frame(spark, x)
    model = sc.fit_pca(df, [f"f{j}" for j in range(6)], 5)
    assert model.n_components(()) == 2  # min(5, d, n - 1)
    model.save(spark, str(tmp_path / "m"))
    loaded = sc.PcaModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(loaded.params[()]["components"], model.params[()]["components"])
    with pytest.raises(ValueError, match="missing"):
        sc.transform(df.drop("f0"), loaded)


def test_knn_rows_cap_and_single_row(spark):
    x = np.random.default_rng(2).normal(size=(30, 5))
    df = _frame(spark, x).withColumn("v", F.array(*[F.col(f"f{j}") for j in range(5)]))
    nn = knn_ops.knn(df, id_col="player_id", vec_col="v", k=10, query_block=7, candidate_block=11).collect()
    assert len(nn) == 300
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in nn:
        order = np.argsort(d[r["player_id"]], kind="stable")
        assert r["neighbor_id"] == order[r["neighbor_rank"] - 1]
        assert r["distance"] == pytest.approx(d[r["player_id"], r["neighbor_id"]], rel=1e-12)
    small = df.where(F.col("player_id") < 4)
    assert knn_ops.knn(small, id_col="player_id", vec_col="v", k=10).count() == 4 * 3
    one = df.where(F.col("player_id") == 0)
    assert knn_ops.knn(one, id_col="player_id", vec_col="v", k=10).count() == 0


@pytest.mark.parametrize("metric,p", [("manhattan", 1), ("chebyshev", 0), ("minkowski", 3)])
def test_knn_metrics(spark, metric, p):
    x = np.random.default_rng(4).normal(size=(20, 4))
    df = _frame(spark, x).withColumn("v", F.array(*[F.col(f"f{j}") for j in range(4)]))
    nn = {(r["player_id"], r["neighbor_rank"]): r for r in knn_ops.knn(df, id_col="player_id", vec_col="v", k=3, metric=metric, p=float(p or 2)).collect()}
    diff = np.abs(x[:, None] - x[None])
    d = diff.sum(-1) if metric == "manhattan" else diff.max(-1) if metric == "chebyshev" else (diff ** 3).sum(-1) ** (1 / 3)
    np.fill_diagonal(d, np.inf)
    for i in range(20):
        assert nn[(i, 1)]["distance"] == pytest.approx(np.sort(d[i])[0], rel=1e-12)


def test_neighbor_table_shape_with_cohorts(spark):
    x = np.random.default_rng(5).normal(size=(12, 3))
    df = _frame(spark, x).withColumn("role", F.when(F.col("player_id") < 6, "batter").otherwise("pitcher")).withColumn(
        "v", F.array("f0", "f1", "f2"))
    t = knn_ops.neighbor_table(df, vec_col="v", k=10)
    assert t.columns == ["player_id", "player_name", "role", "year", "neighbor_rank", "neighbor_player_id",
                         "neighbor_player_name", "distance"]
    rows = t.collect()
    assert len(rows) == 12 * 5
    assert all((r["player_id"] < 6) == (r["neighbor_player_id"] < 6) for r in rows)


def _np_silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in np.unique(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def _np_db(x, lab):
    ks = np.unique(lab)
    c = np.array([x[lab == k].mean(0) for k in ks])
    s = np.array([np.sqrt(((x[lab == k] - c[i]) ** 2).sum(1)).mean() for i, k in enumerate(ks)])
    cd = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    cd[cd == 0] = np.inf
    return float(((s[:, None] + s[None]) / cd).max(1).mean())


def test_silhouette_and_db_match_numpy(spark):
    x, lab = _blobs(n_per=20, centres=3, d=4, std=2.0)
    lab = lab.copy()
    lab[0] = 7  # a singleton cluster scores 0
    df = _frame(spark, x, lab).withColumn("v", F.array(*[F.col(f"f{j}") for j in range(4)]))
    sil = mt.silhouette(df, id_col="player_id", vec_col="v", label_col="label", query_block=9, candidate_block=13).first()
    assert sil["silhouette"] == pytest.approx(_np_silhouette(x, lab), rel=1e-10)
    db = mt.davies_bouldin(df, "v", "label").first()
    assert db["davies_bouldin"] == pytest.approx(_np_db(x, lab), rel=1e-10)
    one = df.withColumn("label", F.lit(0))
    assert mt.silhouette(one, id_col="player_id", vec_col="v", label_col="label").first()["silhouette"] is None
    assert mt.davies_bouldin(one, "v", "label").first()["davies_bouldin"] is None


def test_gmm_finds_blobs_all_covariance_types(spark):
    x, truth = _blobs()
    df = _frame(spark, x).withColumn("v", F.array(*[F.col(f"f{j}") for j in range(6)]))
    for cov in mx.COVARIANCE_TYPES:
        models = mx.fit_mixture(df, "v", 4, covariance_type=cov, n_init=2, seed=0)
        lab = np.array([r["cluster_id"] for r in mx.predict(df, "v", models).orderBy("player_id").collect()])
        for t in range(4):
            assert len(set(lab[truth == t])) == 1
        assert len(set(lab)) == 4
        s = mx.score(df, "v", models).first()
        assert s["bic"] > s["aic"] or cov == "spherical"


def test_gmm_far_from_the_origin(spark):
    x, truth = _blobs()
    for offset in (0.0, 1e8):
        df = _frame(spark, x + offset).withColumn("v", F.array(*[F.col(f"f{j}") for j in range(6)]))
        models = mx.fit_mixture(df, "v", 4, n_init=4, seed=0)
        labels = np.array([r["cluster_id"] for r in mx.predict(df, "v", models).orderBy("player_id").collect()])
        assert [len(set(labels[truth == t])) for t in range(4)] == [1] * 4 and len(set(labels)) == 4


def test_clustering_errors(spark):
    x, _ = _blobs(n_per=1, centres=2)
    df = _frame(spark, x)
    with pytest.raises(ValueError, match="3 are the least"):
        fit_cohort(df, role="batter", year=2024, config=ClusterSpec(2, 2, n_init=1))
    x, _ = _blobs(n_per=5)
    df = _frame(spark, x)
    with pytest.raises(ValueError, match="unknown covariance"):
        fit_cohort(df, role="batter", year=2024, config=ClusterSpec(2, 2, covariance_type="bogus"))
    with pytest.raises(ValueError, match="2 are the least"):
        fit_cohort(df, role="batter", year=2024, config=ClusterSpec(2, 1))
    bad = df.withColumn("f0", F.when(F.col("player_id") == 1, F.lit(None)).otherwise(F.col("f0")))
    with pytest.raises(ValueError, match="missing values: f0"):
        fit_cohort(bad, role="batter", year=2024, config=ClusterSpec(2, 2, n_init=1))
    with pytest.raises(ValueError, match="no cluster spec"):
        spec_of({"pitcher": ClusterSpec(2, 2)}, "batter")
    assert spec_of({"pitcher": ClusterSpec(2, 2), "batter": ClusterSpec(3, 3)}, "batter").n_clusters == 3
    assert spec_of(ClusterSpec(4, 4), "batter").n_clusters == 4


def test_fit_cohort_end_to_end(spark):
    x, truth = _blobs(n_per=40, centres=3, d=5)
    df = _frame(spark, x)
    assign, meta, (pca, gmm) = fit_cohort(df, role="batter", year=2024, config=ClusterSpec(3, 3, n_init=1))
    rows = assign.orderBy("player_id").collect()
    assert len(rows) == 120 and "cluster_id" in assign.columns and "n_pitches_total" in assign.columns
    lab = np.array([r["cluster_id"] for r in rows])
    assert all(len(set(lab[truth == t])) == 1 for t in range(3))
    assert meta["feature_columns"] == [f"f{j}" for j in range(5)] and len(meta["feature_columns_sha256_16"]) == 16
    assert meta["silhouette_score"] > 0.5 and meta["davies_bouldin_score"] > 0


def _cohorts(spark):
    """Four cohorts that differ in features, size and place; one of them has a missing value."""
    frames = {}
    for i, (role, year, d) in enumerate([("batter", 2023, 5), ("batter", 2024, 4), ("pitcher", 2023, 5), ("pitcher", 2024, 3)]):
        x, _ = _blobs(n_per=20 + i, centres=3, d=d)
        df = _frame(spark, x + 10 * i).withColumn("role", F.lit(role)).withColumn("year", F.lit(year))
        frames[role, year] = df.withColumnRenamed("f1", f"own_{i}")
    frames["pitcher", 2023] = frames["pitcher", 2023].withColumn("f0", F.when(F.col("player_id") > 0, F.col("f0")))
    frames["batter", 2024] = frames["batter", 2024].drop("n_pitches_total")
    return frames


def test_all_cohorts_in_the_same_jobs(spark):
    """Each cohort gets what it gets alone; a faulty one is reported and stops no other."""
    frames = _cohorts(spark)
    specs = {key: ClusterSpec(2, 3, n_init=2) if key[0] == "batter" else ClusterSpec(2, 2, n_init=1, covariance_type="diag") for key in frames}
    together = fit_cohorts(frames, specs)
    assert set(together) == set(frames)
    assert isinstance(together["pitcher", 2023], ValueError) and "missing values: f0 (1)" in str(together["pitcher", 2023])
    for key in set(frames) - {("pitcher", 2023)}:
        assign, meta, (pca, gmm) = together[key]
        alone = fit_cohort(frames[key], role=key[0], year=key[1], config=specs[key])
        own = sc.fit_pca(frames[key], sc.model_feature_columns(frames[key]), 2)
        assert pca.feature_columns == own.feature_columns and np.allclose(pca.params[()]["components"], own.params[()]["components"], atol=1e-9)
        assert np.allclose(gmm.means, alone[2][1].means, atol=1e-8) and gmm.n_iter == alone[2][1].n_iter
        assert assign.columns == alone[0].columns and ("n_pitches_total" in assign.columns) == (key != ("batter", 2024))
        assert [f.dataType for f in assign.schema] == [f.dataType for f in alone[0].schema]
        assert sorted(map(tuple, assign.collect())) == sorted(map(tuple, alone[0].collect()))
        features = sc.model_feature_columns(frames[key])
        assert sorted(map(tuple, assign.select("player_id", *features).collect())) == sorted(map(tuple, frames[key].select("player_id", *features).collect()))
        for name in ("gmm_aic", "gmm_bic", "silhouette_score", "davies_bouldin_score", "n_samples"):
            assert meta[name] == pytest.approx(alone[1][name], rel=1e-9)
    assert fit_cohorts({}, {}) == {}


def test_a_failing_fit_is_reported_alone(spark, monkeypatch):
    frames = {key: df for key, df in _cohorts(spark).items() if key[0] == "batter"}
    fit = mx.fit_mixture

    def fails(df, *args, **kwargs):
        if df.where("year = 2024").count():
            raise np.linalg.LinAlgError("not positive definite")
        return fit(df, *args, **kwargs)

    monkeypatch.setattr(mx, "fit_mixture", fails)
    done = fit_cohorts(frames, {key: ClusterSpec(2, 3, n_init=1) for key in frames})
    assert isinstance(done["batter", 2024], np.linalg.LinAlgError) and done["batter", 2023][1]["n_samples"] == 60


def test_sweeps_and_best(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    grid = tn.grid_sweep(spark, df, id_col="id", feature_cols=["a", "b", "c"], pca_sizes=[2, 3], k_min=2, k_max=3)
    assert grid.count() == 4 and set(grid.columns) >= {"pca_n_components", "k", "inertia", "silhouette", "davies_bouldin"}
    best = tn.best_row(grid, "silhouette", ascending=False).first()
    assert best["silhouette"] == max(r["silhouette"] for r in grid.collect())
    assert tn.top_by(grid, "inertia", n=2).count() == 2


def test_top_k_ties_ordered_by_id():
    d = np.array([[1.0, 0.5, 0.5, 0.5, np.inf], [np.inf, 2.0, 1.0, 3.0, 1.0]])
    ids = np.array([10, 13, 11, 12, 9])
    r, c, dd = knn_ops.top_k_per_row(d, ids, 2)
    assert r.tolist() == [0, 0, 1, 1]
    assert ids[c].tolist() == [11, 12, 9, 11] and dd.tolist() == [0.5, 0.5, 1.0, 1.0]


def test_joint_kmeans_recovers_blobs_and_inertia(spark):
    x, truth = _blobs(n_per=30, centres=3, d=3)
    df = _frame(spark, x).withColumn("v", F.array("f0", "f1", "f2"))
    fits = mx.fit_kmeans(df, "v", [2, 3, 4], n_init=2, seed=1)
    centres, inertia = fits[((), 3)]
    lab = np.array([r["cluster_id"] for r in mx.assign_nearest(df, "v", {(): centres}).orderBy("player_id").collect()])
    assert all(len(set(lab[truth == t])) == 1 for t in range(3))
    ref = sum(((x[lab == j] - x[lab == j].mean(0)) ** 2).sum() for j in range(3))
    assert inertia == pytest.approx(ref, rel=1e-9)
    assert fits[((), 2)][1] > inertia > fits[((), 4)][1]


def test_knn_rows_that_share_an_id(spark):
    """Only the row itself is left out: three rows, two with one id, have two neighbours each."""
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0])], "pid long, v array<double>")
    got = knn_ops.knn(df, id_col="pid", vec_col="v", k=2, query_block=2, candidate_block=2).collect()
    assert sorted((r["pid"], r["neighbor_rank"], r["neighbor_id"], r["distance"]) for r in got) == [
        (1, 1, 1, 1.0), (1, 1, 1, 1.0), (1, 2, 2, 2.0), (1, 2, 2, 3.0), (2, 1, 1, 2.0), (2, 2, 1, 3.0),
    ]


def test_seeds_come_from_all_rows_and_equal_rows_once(spark):
    """A blob of a few rows among many equal ones is found by the seeding."""
    rows = [(i, [0.0, 0.0]) for i in range(5000)] + [(9000 + i, [50.0 + i, 50.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    (centres, inertia), = mx.fit_kmeans(df, "v", [2], seed=3).values()
    assert np.allclose(sorted(c.tolist() for c in centres), [[0.0, 0.0], [51.0, 50.0]]) and inertia == pytest.approx(2.0)


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_fit_from_given_parameters_climbs_and_continues(spark, kind):
    """The likelihood never falls, cohorts run side by side far from the origin, and a fit continues where another stopped."""
    x, truth = _blobs(n_per=40, centres=2, d=2, std=1.5)
    rows = [(i, "far" if i % 2 else "near", (v + (1e6 if i % 2 else 0.0)).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, side string, v array<double>").repartition(3)
    shape = {"full": [np.eye(2) * 9] * 2, "tied": np.eye(2) * 9, "diag": [[9.0, 9.0]] * 2, "spherical": [9.0, 9.0]}[kind]

    def start(shift):
        return mx.Mixture(kind, np.array([0.5, 0.5]), np.array([x[0], x[-1]]) + shift, np.array(shape))

    starts = {("near",): start(0.0), ("far",): start(1e6)}
    got = mx.fit_from(df, "v", starts, 6, cohort=["side"]).collect()
    for side in ("near", "far"):
        steps = sorted({(r["step"], r["mean_log_likelihood"]) for r in got if r["side"] == side})
        assert len(steps) == 7 and all(b[1] >= a[1] - 1e-9 for a, b in zip(steps, steps[1:]))
    last = {(r["side"], r["component"]): r for r in got if r["step"] == 3}
    cov = {s: np.array([last[s, j]["covariance"] for j in range(2)]) for s in ("near", "far")}
    reshape = {"full": lambda c: c.reshape(2, 2, 2), "tied": lambda c: c[0].reshape(2, 2), "diag": lambda c: c, "spherical": lambda c: c[:, 0]}[kind]
    again = {(s,): mx.Mixture(kind, np.array([last[s, j]["weight"] for j in range(2)]), np.array([last[s, j]["mean"] for j in range(2)]), reshape(cov[s])) for s in cov}
    more = {(r["side"], r["component"]): r for r in mx.fit_from(df, "v", again, 3, cohort=["side"]).collect() if r["step"] == 3}
    for r in got:
        if r["step"] == 6:
            other = more[r["side"], r["component"]]
            assert np.allclose(r["mean"], other["mean"], rtol=1e-9) and np.allclose(r["covariance"], other["covariance"], rtol=1e-5, atol=1e-6)
    with pytest.raises(ValueError, match="passes"):
        mx.fit_from(df, "v", starts, -1, cohort=["side"])
