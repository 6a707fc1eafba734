"""Steps that must shuffle, hold or compute no more than they need, with the results of the plain way."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchlake import fixtures as fx
from pitchlake.operators import cells, dedupe, gold, knn, measures, metrics
from pitchlake.operators import features as ft
from pitchlake.operators import mixture as mx

SF0001 = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.na.fill(-1.5).collect())


@pytest.mark.parametrize("most", [1 << 20, 70])
def test_many_player_seasons_are_shuffled_once(spark, monkeypatch, most):
    src = fx.pitches(spark, SF0001)
    src = src.unionByName(src.where("row_tiebreak % 7 = 0").withColumn("release_speed", F.col("release_speed") + 1))
    params = ft.FeatureParams(min_pitches_pitcher=1)
    plain = ft.pitcher_features(src, params, with_pitch_types=False)
    monkeypatch.setattr(ft, "MANY", 1)
    monkeypatch.setattr(ft, "MOST", most)
    once = ft.pitcher_features(src, params, with_pitch_types=False)
    assert once.columns == plain.columns and _rows(once) == _rows(plain)
    if most > 70:
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        # sorted once, also for the quartiles; no text goes through the shuffle
        assert plan.count("Sort [") == 1 and "ObjectHashAggregate" not in plan
        dealt = plan.split("Exchange hashpartitioning")[1].split("Project [")[1].splitlines()[0]
        assert "_flags_0" in dealt and not any(f"{c}#" in dealt.split("_flags_0")[1] for c in ("description", "stand", "launch_angle"))


@pytest.mark.parametrize("role", ["pitcher", "batter"])
def test_many_player_seasons_with_missing_values_and_columns(spark, monkeypatch, role):
    rng, rows = np.random.default_rng(21), []
    texts = {"description": ["Swinging_Strike", "foul", "ball", "hit_into_play", None], "pitch_type": ["FF", " sl", "UN", None], "type": ["S", "x ", None],
             "stand": ["R", "l ", "S", None], "bb_type": ["Popup", "fly_ball", " ", None]}
    numbers = ["release_speed", "release_spin_rate", "release_extension", "pfx_x", "pfx_z", "plate_x", "plate_z", "sz_bot", "sz_top", "launch_speed", "launch_angle",
               "hc_x", "hc_y", "iso_value", "estimated_slg_using_speedangle", "woba_value", "estimated_woba_using_speedangle", "delta_run_exp", "sprint_speed"]
    for i in range(400):
        player, year = [(None, 2024), (1, None), (1, 2024), (2, 2024), (3, 2025)][i % 5] if i != 7 else (4, 2024)
        row = {"pitcher": player, "batter": player, "year": year, "game_pk": i // 9, "at_bat_number": i % 2, "pitch_number": 1 if i % 3 else None,
               "game_date": dt.date(2024, 4, 1), "row_tiebreak": i % 4, "zone": [None, 5, 9, 12][rng.integers(4)]}
        row |= {n: v[rng.integers(len(v))] for n, v in texts.items()}
        row |= {n: None if rng.random() < 0.2 else float(rng.normal(30, 60)) for n in numbers}
        rows.append(tuple(row.values()))
    ids = ", ".join(["pitcher long, batter long, year int, game_pk long, at_bat_number int, pitch_number int, game_date date, row_tiebreak long, zone int",
                     *[f"{n} string" for n in texts], *[f"{n} double" for n in numbers]])
    src = spark.createDataFrame(rows, ids)
    params = ft.FeatureParams(min_pitches_pitcher=1, min_pitches_batter=1, min_batted_ball_batter=0)
    make = (lambda d: ft.pitcher_features(d, params, with_pitch_types=False)) if role == "pitcher" else (lambda d: ft.batter_features(d, params))
    few = ["sz_bot", "sz_top", "stand", "bb_type", "delta_run_exp", "sprint_speed", "type"]
    plain = [_rows(make(d)) for d in (src, src.drop(*few))]
    monkeypatch.setattr(ft, "MANY", 1)
    found = [make(d) for d in (src, src.drop(*few))]
    assert [_rows(d) for d in found] == plain and len(plain[0]) >= 4
    if role == "pitcher":  # with the counts by type, which read the pitch type itself
        typed = ft.pitcher_features(src, params)
        assert _rows(typed.drop("pitch_type_entropy", "pitch_type_shares", "pitch_type_means")) == plain[0]
    assert all("_flags_0" in d._jdf.queryExecution().executedPlan().toString() for d in found)


def test_correlations_run_the_plan_of_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([("a", float(i), float(i * i % 7)) for i in range(50)], "k string, x double, y double")
    assert gold.correlation_long(rows.mapInPandas(watched, rows.schema), ["k"], ["x", "y"]).count() == 1
    assert seen.value == 50


@pytest.mark.parametrize("metric,p", [("euclidean", 2.0), ("manhattan", 1.0), ("chebyshev", 2.0), ("minkowski", 3.0), ("minkowski", 2.5)])
@pytest.mark.parametrize("scale,away", [(1.0, 0.0), (1e-3, 1e4), (1e10, 0.0)])
def test_rough_distances_lose_no_neighbour(metric, p, scale, away):
    x = np.random.default_rng(5).normal(size=(300, 16)) * scale + away
    x[200:240] = x[:40]
    ids = np.arange(len(x))
    itself = lambda s, e: ids[s:e, None] == ids[None, :]
    d = np.array([cells.of_pairs(np.repeat(x[i:i + 1], len(x), axis=0), x, metric, p) for i in ids])
    d[itself(0, 300)] = np.inf
    want = knn.top_k_per_row(d, ids, 5)
    got = knn.nearest(x, x, ids, 5, metric, p, itself)
    bounded = knn.nearest(x, x, ids, 5, metric, p, itself, want[2].reshape(300, 5)[:, -1])
    for a, b, c in zip(want, got, bounded):
        assert np.array_equal(a, b) and np.array_equal(a, c)


def test_euclidean_distances_of_near_and_equal_rows():
    x = np.random.default_rng(6).normal(size=(50, 8)) + 1e3
    x[25:] = x[:25] + 1e-7
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(cells.euclidean(x)(x), want, rtol=1e-9, atol=0)


def test_silhouettes_deal_one_query_block_over_tasks(spark):
    x = np.random.default_rng(7).normal(size=(90, 3))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, l long")
    whole = metrics.silhouette(df, id_col="id", vec_col="v", label_col="l").first()["silhouette"]
    dealt = metrics.silhouette(df, id_col="id", vec_col="v", label_col="l", query_block=40, candidate_block=7).first()["silhouette"]
    assert dealt == pytest.approx(whole, abs=1e-12)


def test_two_blocks_meet_once_for_both():
    rng = np.random.default_rng(8)
    x, lab = rng.normal(size=(900, 4)), rng.integers(0, 3, 900)
    ids = np.r_[np.arange(300), np.arange(10, 610)]  # ids of both blocks, and ids that come twice in one
    ids[-5:] = 7

    def block(at, pre):
        n = len(at)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), pa.array(x[at].ravel()))
        labels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(lab[at]))
        return {pre + name: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values) for name, values in (("_id", pa.array(ids[at])), ("_v", vectors), ("_ls", labels))}

    schema = pa.schema([("_id", pa.int64()), ("_labelling", pa.int32()), ("_own", pa.int64()), ("_other", pa.int64()), ("_sum", pa.float64()), ("_cnt", pa.int64())])
    one, two = np.arange(300), np.arange(300, 900)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for a, b, twice in ((one, two, True), (two, two, False)):
        held = {**block(a, ""), **block(b, "c"), "_twice": pa.array([twice])}
        batch = pa.RecordBatch.from_arrays(list(held.values()), names=list(held))
        got, want = {}, {}
        for out in metrics._distance_sums([], schema)([batch]):
            for r in out.to_pylist():
                key = (r["_id"], r["_own"], r["_other"])
                total, n = got.get(key, (0.0, 0))
                got[key] = total + r["_sum"], n + r["_cnt"]
        for i, others in [(i, b) for i in a] + ([(i, a) for i in b] if twice else []):
            for label in range(3):
                near = others[(lab[others] == label) & (ids[others] != ids[i])]
                total, n = want.get((ids[i], lab[i], label), (0.0, 0))
                want[ids[i], lab[i], label] = total + d[i, near].sum(), n + len(near)
        assert got.keys() == want.keys() and all(got[k] == (pytest.approx(v[0], rel=1e-12), v[1]) for k, v in want.items())


def test_all_labels_in_one_pass(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, v array<double>")
    centres = {f"k{k}": {(): np.array([[20.0 * j / k, 0.0] for j in range(k)])} for k in (2, 3, 5)}
    both = mx.assign_nearest_all(df, "v", centres)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    for name, c in centres.items():
        one = {r["id"]: r[name] for r in mx.assign_nearest(df, "v", c, out_col=name).collect()}
        assert one == {r["id"]: r[name] for r in both.collect()}


def test_dedupe_by_a_given_hash_and_together(spark):
    src = fx.pitches(spark, SF0001).where(F.col("pitcher").isNotNull()).withColumn("game_date", F.lit(dt.date(2024, 4, 1)))
    src = src.unionByName(src.withColumn("zone", F.lit(3))).checkpoint()  # copies that only the row hash tells apart
    keys = ("pitcher", "year")
    plain = dedupe.dedupe_last(src, keys)
    for other in (dedupe.dedupe_last(src, keys, together=keys), dedupe.dedupe_last(src, keys, hashed="_h").drop("_h"),
                  dedupe.dedupe_last(src, keys, together=keys, kept=[*src.columns, "_h"], hashed="_h").drop("_h")):
        assert other.columns == plain.columns and other.exceptAll(plain).isEmpty() and plain.exceptAll(other).isEmpty()
    assert measures.MOST == 1 << 20
