"""Exact neighbour search through metric cells, and silhouettes of many labellings at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import cells
from pitchlake.operators import knn as kn
from pitchlake.operators import metrics as mt


def _clustered(n_centres=40, each=25, d=3, seed=0, far=200.0):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-far, far, size=(n_centres, d))
    return np.vstack([c + rng.normal(0, 0.5, size=(each, d)) for c in centres])


def _plain(ids, x, k, metric, p):
    d = cells.pairwise(x, x, metric, p)
    out = set()
    for i in range(len(x)):
        order = sorted((d[i, j], ids[j], j) for j in range(len(x)) if j != i)[:k]
        out |= {(ids[i], rank, near, round(dist, 9)) for rank, (dist, near, _) in enumerate(order, 1)}
    return out


def _got(df):
    return {(r["id"], r["neighbor_rank"], r["neighbor_id"], round(r["distance"], 9)) for r in df.collect()}


@pytest.mark.parametrize("metric,p", [("euclidean", 2.0), ("manhattan", 1.0), ("chebyshev", 2.0), ("minkowski", 3.0)])
def test_search_through_cells_is_exact(spark, metric, p):
    """Clusters, a lattice full of ties, and one vector that a third of all rows share."""
    x = np.vstack([_clustered(12, 12), [[i % 5, i // 5, 0.0] for i in range(40)], np.full((90, 3), 2.5)])
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>").repartition(4)
    got = kn.knn(df, id_col="id", vec_col="v", k=4, metric=metric, p=p, candidate_block=16, query_block=13, fan=4)
    assert _got(got) == _plain(ids, x, 4, metric, p)


def test_cohorts_string_ids_and_chosen_queries(spark):
    x = _clustered(10, 10)
    rows = [(f"r{i}", "big" if i < 90 else "small", v.tolist(), "clash") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, side string, v array<double>, metric string")
    got = kn.knn(df, id_col="id", vec_col="v", k=3, metric="euclidean", cohort=["side"], candidate_block=20, query_block=8, fan=3)
    names = [r[0] for r in rows]
    assert _got(got) == _plain(names[:90], x[:90], 3, "euclidean", 2) | _plain(names[90:], x[90:], 3, "euclidean", 2)
    some = kn.knn(df, id_col="id", vec_col="v", k=3, metric="euclidean", cohort=["side"], candidate_block=20, query_block=8, fan=3, only_ids=["r5", "r95"])
    assert _got(some) == {r for r in _got(got) if r[0] in ("r5", "r95")}
    assert kn.knn(df.limit(0), id_col="id", vec_col="v", k=3).collect() == []


def test_few_pairs_of_blocks_on_clustered_data(spark):
    """2,000 rows in 80 far clusters: blocks meet few cells, where all pairs would meet every one."""
    x = _clustered(80, 25, d=4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, _v array<double>")
    base = df.select(F.lit(0).alias("_all"), "_id", F.lit(1).alias("_copy"), "_v", F.lit(True).alias("_first"), F.lit(True).alias("_counts"))
    placed, nodes = cells.metric_tree(base, ["_all"], most=40, fan=8, block=500)
    sizes = [r[0] for r in placed.groupBy("_node").count().select("count").collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 40
    held = {r["_node"]: (np.array(r["_centre"]), r["_radius"]) for r in nodes.collect()}
    for r in placed.collect():  # every ancestor's ball holds the row
        path = r["_node"].split(".")[1:]
        for depth in range(1, len(path) + 1):
            centre, radius = held["." + ".".join(path[:depth])]
            assert np.linalg.norm(np.array(r["_v"]) - centre) <= radius + 1e-9
    found = {}
    original = kn.cell_pairs

    def counted(*args):
        blocks, pairs = original(*args)
        found["blocks"], found["pairs"] = blocks.count(), pairs.count()
        return blocks, pairs

    kn.cell_pairs = counted
    try:
        got = kn.knn(df, id_col="_id", vec_col="_v", k=5, metric="euclidean", candidate_block=40, query_block=40, fan=8)
        rows = {(r["_id"], r["neighbor_rank"], r["neighbor_id"], round(r["distance"], 9)) for r in got.collect()}
    finally:
        kn.cell_pairs = original
    assert rows == _plain(list(range(2000)), x, 5, "euclidean", 2)
    assert found["blocks"] >= 50 and found["pairs"] < 0.1 * found["blocks"] * len(sizes)


def test_silhouettes_of_many_labellings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    labels = [rng.integers(0, k, 60) for k in (1, 2, 3, 59)]
    labels[3][:59] = np.arange(59)
    rows = [(i, v.tolist(), *(int(lab[i]) for lab in labels)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, a long, b long, c long, d long")
    got = {r["labelling"]: r for r in mt.silhouettes(df, id_col="id", vec_col="v", label_cols=["a", "b", "c", "d"], query_block=7, candidate_block=11).collect()}
    assert got["a"]["silhouette"] is None and got["a"]["n_clusters"] == 1
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for name, lab in zip("bcd", labels[1:]):
        s = []
        for i in range(60):
            own = (lab == lab[i]) & (np.arange(60) != i)
            far = min(d[i, lab == other].mean() for other in set(lab) - {lab[i]})
            s.append(0.0 if not own.any() else (far - d[i, own].mean()) / max(far, d[i, own].mean()))
        assert got[name]["silhouette"] == pytest.approx(np.mean(s), abs=1e-12)
        one = mt.silhouette(df, id_col="id", vec_col="v", label_col=name).first()
        assert one["silhouette"] == pytest.approx(np.mean(s), abs=1e-12)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "minkowski"])
@pytest.mark.parametrize("bounded", [False, True])
def test_neighbours_are_found_in_many_tiles(monkeypatch, metric, bounded):
    monkeypatch.setattr(kn, "TILE", (32, 50))
    monkeypatch.setattr(kn, "TILE_SUMS", (16, 64))
    x = np.random.default_rng(11).normal(size=(300, 24))
    x[250:270] = x[:20]
    ids = np.arange(300)
    d = np.array([cells.of_pairs(np.repeat(x[i:i + 1], 300, axis=0), x, metric, 3.0) for i in ids])
    d[ids, ids] = np.inf
    want = kn.top_k_per_row(d, ids, 5)
    tau = want[2].reshape(300, 5)[:, -1] if bounded else None
    got = kn.nearest(x, x, ids, 5, metric, 3.0, lambda s, e: ids[s:e, None] == ids[None, :], tau)
    assert all(np.array_equal(a, b) for a, b in zip(want, got))
    if bounded:
        tau[::7] = np.inf  # rows that have no bound yet
        some = kn.nearest(x[:90], x[100:], ids[100:], 5, metric, 3.0, None, np.minimum(tau[:90], d[:90, 100:].max()))
        for i in range(90):
            near = sorted((v, j + 100) for j, v in enumerate(d[i, 100:]) if v <= tau[i])[:5]
            assert [(v, ids[100 + j]) for v, j in zip(some[2][some[0] == i], some[1][some[0] == i])] == near


def test_whole_steps_lose_no_pair():
    rng = np.random.default_rng(12)
    q, c = rng.standard_t(2, size=(40, 40)), rng.standard_t(2, size=(70, 40))
    for metric in ("manhattan", "chebyshev"):
        d = cells.pairwise(q, c, metric, 1.0)
        bound = np.quantile(d, 0.02, axis=1)
        steps = cells.Whole(q, c, metric)
        at = steps.within(slice(0, 40), slice(0, 70), bound)
        assert set(np.flatnonzero(d <= bound[:, None])) <= set(at) and len(at) < d.size / 2


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e12])
def test_chebyshev_neighbours_come_from_boxes(monkeypatch, scale):
    rng = np.random.default_rng(14)
    c = np.round(rng.normal(size=(1500, 12)), 1) * scale  # many equal coordinates, on cuts and ends of boxes
    c[1400:] = c[:100]
    q, ids, taken = c[:1100], rng.permutation(1500), []
    d = cells.pairwise(q, c, "chebyshev", np.inf)
    tau = np.sort(d, axis=1)[:, 9]
    monkeypatch.setattr(kn, "of_pairs", lambda a, *more: taken.append(len(a)) or cells.of_pairs(a, *more))
    monkeypatch.setattr(kn, "Whole", None)
    got = kn.nearest(q, c, ids, 10, "chebyshev", 2.0, None, tau)
    assert all(np.array_equal(a, b) for a, b in zip(kn.top_k_per_row(d, ids, 10), got))
    assert sum(taken) < d.size / 8
    mine = np.arange(1500)
    d[mine[:1100], mine[:1100]] = np.inf
    if scale < 1e9:  # a bound of its own, without the rows themselves
        got = kn.nearest(q, c, ids, 10, "chebyshev", 2.0, lambda s, e: mine[:1100][s:e, None] == mine[None, :])
        assert all(np.array_equal(a, b) for a, b in zip(kn.top_k_per_row(d, ids, 10), got))


def test_a_cell_is_sent_once_to_a_group_of_blocks(spark, monkeypatch):
    x = np.random.default_rng(13).normal(size=(500, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found, original = {}, kn._beyond

    def counted(blocks, pairs, *more):
        out = original(blocks, pairs, *more)
        found["pairs"], found["sent"] = pairs.count(), out.count()
        return out

    monkeypatch.setattr(kn, "_beyond", counted)
    for group in (1 << 16, 100):
        monkeypatch.setattr(kn, "GROUP", group, raising=False)
        got = kn.knn(df, id_col="id", vec_col="v", k=4, metric="manhattan", candidate_block=20, query_block=20, fan=8)
        assert {(r["id"], r["neighbor_rank"], r["neighbor_id"], round(r["distance"], 9)) for r in got.collect()} == _plain(list(range(500)), x, 4, "manhattan", 1)
        if group > 500:
            assert found["sent"] < found["pairs"] / 2


def test_euclidean_balls_rule_out_minkowski_pairs(monkeypatch):
    """Beyond the own cell few pairs get their powers summed up; the neighbours are those of all pairs."""
    rng, summed, keep = np.random.default_rng(4), [], cells._each_dimension
    monkeypatch.setattr(cells, "_each_dimension", lambda q, columns, *given, **more: summed.append(len(q) * columns.shape[1]) or keep(q, columns, *given, **more))
    q, c = rng.normal(size=(700, 64)), rng.normal(size=(6000, 64))
    c[:700] = q + 0.02 * rng.normal(size=(700, 64))
    c[700:720], q[3] = c[3], c[3]  # ties go by id
    far, lattice = q.copy(), np.round(c)
    far[5] += 1e6
    for a, b, p, most in ((q, c, 3.0, 0.2), (q, c, 2.5, 0.2), (q, c, 1.5, 2.0), (np.round(q), lattice, 3.0, 2.0), (far, c + 1e5, 3.0, 2.0)):
        ids = rng.permutation(len(b))
        d = cells.pairwise(a, b, "minkowski", p)
        order = np.lexsort((np.broadcast_to(ids, d.shape), d))[:, :5]
        tau = np.take_along_axis(d, order[:, 4:], axis=1)[:, 0] * np.where(np.arange(len(a)) % 2, 1 + 1e-9, 1.02)
        summed.clear()
        i, j, found = kn.nearest(a, b, ids, 5, "minkowski", p, None, tau)
        assert sum(summed) <= most * d.size
        within = np.take_along_axis(d, order, axis=1) <= tau[:, None]
        assert np.array_equal(i, np.repeat(np.arange(len(a)), within.sum(axis=1))) and np.array_equal(j, order[within])
        assert np.allclose(found, np.take_along_axis(d, order, axis=1)[within], rtol=1e-12)
