"""Exact quartiles where a group does not fit in one buffer, and feature parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions.aggs import iqr
from pitchlake.operators import quantiles as qt


def test_by_ranks_equals_percentile(spark):
    """One key holds a third of all rows, all its values distinct; no partition of ranks holds them all."""
    rng = np.random.default_rng(0)
    rows = [("hot", 1, float(v), float(v % 7)) for v in rng.permutation(3000)]
    rows += [(f"k{i % 40}", i % 3, float(x), None) for i, x in enumerate(rng.normal(size=6000).round(2))]
    rows += [("one", 0, 4.0, None), ("none", 0, None, None), (None, None, 1.0, 2.0), (None, None, 5.0, 8.0), ("nan", 0, float("nan"), 1.0), ("nan", 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, year int, a double, b double").repartition(6)
    measures = {"a_iqr": "a", "b_iqr": "b"}
    plain = {(r["k"], r["year"]): (repr(r["a_iqr"]), repr(r["b_iqr"])) for r in df.groupBy("k", "year").agg(iqr("a").alias("a_iqr"), iqr("b").alias("b_iqr")).collect()}
    for most in (10**6, 400, 60):
        got = {(r["k"], r["year"]): (repr(r["a_iqr"]), repr(r["b_iqr"])) for r in qt.iqrs(df, ["k", "year"], measures, most=most).collect()}
        assert got == {k: v for k, v in plain.items() if k[0] != "none"}, most


def test_no_chunk_holds_a_hot_group(spark, monkeypatch):
    rows = [("hot", float(i)) for i in range(20_000)] + [(f"k{i}", float(i)) for i in range(40_000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    counts = qt.value_counts(df, ["k"], {"x": "x"})
    seen = {}
    original = qt.match

    def watched(left, right, keys, how="inner"):
        if "_part" in keys:
            seen["chunks"] = [r["count"] for r in left.groupBy(*keys).count().collect()]
            seen["kept"] = right.count()
        return original(left, right, keys, how)

    monkeypatch.setattr(qt, "match", watched)
    got = {r["k"]: r for r in qt.quantiles_of_counts(counts, ["k"], (0.25, 0.5, 0.75), most=1000).collect()}
    assert got["hot"]["quantiles"] == [4999.75, 9999.5, 14999.25] and got["hot"]["n"] == 20_000
    assert got["k7"]["quantiles"] == [7.0] * 3
    assert max(seen["chunks"]) < 20_000 / 5 and len(seen["chunks"]) >= 8
    assert seen["kept"] <= 6  # only chunks that hold a wanted rank are summed value by value


@pytest.mark.parametrize("role", ["pitcher", "batter"])
def test_features_equal_one_aggregate(spark, role):
    """The split aggregate equals the families' own columns in one aggregate, whatever the bound of a buffer."""
    from pitchlake import fixtures as fx
    from pitchlake.operators import features as ft
    from pitchlake.operators import measures

    df = ft.prepare_role_pitches(fx.pitches(spark, "/root/testdata/sf0.001"), role)
    families = ft.pitcher_families() if role == "pitcher" else ft.batter_families(ft.FeatureParams())
    got = ft.aggregate_families(df, (role, "year"), families)
    one = df.groupBy(role, "year").agg(F.count(F.lit(1)).alias("n_pitches_total"), *[c for fam in families for c in fam(df)])
    assert got.columns == one.columns
    many = measures.aggregated(df, (role, "year"), ft.features_of(df, families), F.count(F.lit(1)).alias("n_pitches_total"), most=70)
    assert many.columns == one.columns
    rounded = lambda d: sorted(tuple(round(v, 10) if isinstance(v, float) else v for v in r) for r in d.na.fill(-1.5).collect())
    assert rounded(got) == rounded(one) == rounded(many)
