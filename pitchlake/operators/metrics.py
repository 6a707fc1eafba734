"""Cluster quality metrics and profiles.

* Davies-Bouldin: centroids and scatters are grouped aggregates; the small
  cluster x cluster step runs with SQL higher-order functions over the per-cohort
  list of centroids (bounded by the number of clusters), no join of clusters.
* Silhouette (plain Euclidean, unlike ``ClusteringEvaluator``) needs the distance
  sum of every row to every cluster, so every two blocks meet once, whichever comes
  first -- for any number of labellings at a time: NumPy computes their distances in
  tiles that fit in the processor's cache and multiplies them with the membership
  matrices of both blocks. One grouped sum merges the blocks. No row pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import each_row, euclidean, in_blocks, matrix


#: distances are taken for so many rows of one block and of the other at a time
TALL, WIDE = 256, 512
#: a cohort is cut into so many blocks at least, unless they would get too small, so that its pairs of blocks are many tasks
FEWEST = 8


def _vec(c: str):
    return F.col(c).cast("array<double>")


def centroids(df: DataFrame, vec_col: str, label_col: str, cohort: Sequence[str] = ()) -> DataFrame:
    """(cohort..., label, n, centroid array<double>) via a per-dimension average."""
    ck = list(cohort)
    long = df.select(*ck, F.col(label_col).alias("_l"), F.posexplode(_vec(vec_col)).alias("_i", "_x"))
    per_dim = long.groupBy(*ck, "_l", "_i").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return per_dim.groupBy(*ck, "_l").agg(
        F.max("_n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"),
    ).withColumnRenamed("_l", label_col)


def _euclid(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def davies_bouldin(df: DataFrame, vec_col: str, label_col: str, cohort: Sequence[str] = ()) -> DataFrame:
    """(cohort..., davies_bouldin, n_clusters); NULL with fewer than two clusters."""
    ck = list(cohort)
    cents = centroids(df, vec_col, label_col, ck)
    scat = (
        df.select(*ck, label_col, _vec(vec_col).alias("_v"))
        .join(cents.select(*ck, label_col, "centroid"), [*ck, label_col], "inner")
        .groupBy(*ck, label_col)
        .agg(F.avg(_euclid(F.col("_v"), F.col("centroid"))).alias("scatter"))
    )
    per = cents.join(scat, [*ck, label_col], "inner").select(*ck, F.struct(
        F.col(label_col).alias("l"), F.col("centroid").alias("c"), F.col("scatter").alias("s")).alias("_k"))
    grouped = per.groupBy(*ck).agg(F.collect_list("_k").alias("_ks")) if ck else per.agg(F.collect_list("_k").alias("_ks"))

    def worst(a):
        others = F.filter(F.col("_ks"), lambda b: b["l"] != a["l"])
        ratios = F.transform(others, lambda b: F.when(_euclid(a["c"], b["c"]) > 0, (a["s"] + b["s"]) / _euclid(a["c"], b["c"])).otherwise(F.lit(0.0)))
        return F.array_max(ratios)

    n = F.size("_ks")
    per_cluster = F.transform(F.col("_ks"), worst)
    db = F.aggregate(per_cluster, F.lit(0.0), lambda acc, v: acc + v) / n
    return grouped.select(*ck, F.when(n >= 2, db).alias("davies_bouldin"), n.alias("n_clusters"))


class _Equal:
    """Which rows of one block have the id of which rows of another (a missing number equals none)."""

    def __init__(self, mine: np.ndarray, others: np.ndarray):
        if mine.dtype == object or others.dtype == object:
            seen: dict = {}
            mine, others = (np.array([seen.setdefault(x, len(seen)) for x in ids], dtype=np.int64) for ids in (mine, others))
        self.order = np.argsort(others, kind="stable")
        self.low = np.searchsorted(others, mine, sorter=self.order)
        self.n = np.searchsorted(others, mine, side="right", sorter=self.order) - self.low
        self.n[mine != mine] = 0

    def of(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        """(row less ``s``, row of the other block) of every such pair of the rows s..e."""
        low, n = self.low[s:e], self.n[s:e]
        return np.repeat(np.arange(len(n)), n), self.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _membership(labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The labels of every labelling, where its columns begin and end, and rows x labels (1 where a row has the label), side by side."""
    found = [np.unique(labels[:, labelling], return_inverse=True) for labelling in range(labels.shape[1])]
    ends = np.cumsum([0, *[len(names) for names, _ in found]])
    member = np.zeros((len(labels), ends[-1]))
    for start, (_, at) in zip(ends, found):
        member[np.arange(len(at)), start + at] = 1.0
    return [names for names, _ in found], ends, member


def _distance_sums(names: Sequence[str], schema: pa.Schema):
    """Distance sums and counts of each row to each cluster of each labelling, for two blocks at a time: of the first block's
    rows to the second's, and where ``_twice`` of the second's to the first's."""

    def emit(r, ids, own, found, ends, sums, counts):
        n = len(ids)
        for labelling, labels in enumerate(found):
            total, count = (x[:, ends[labelling]:ends[labelling + 1]].ravel() for x in (sums, counts))
            cols = [pa.repeat(r[c_], n * len(labels)) for c_ in names]
            cols += [ids.take(pa.array(np.repeat(np.arange(n), len(labels)))), pa.repeat(labelling, n * len(labels))]
            cols += [pa.array(x) for x in (np.repeat(own[:, labelling], len(labels)), np.tile(labels, n), total, count)]
            out = pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema)], schema=schema)
            yield out.filter(pa.array(count > 0))

    def run(batches):
        for r in each_row(batches):
            ids, c_ids, twice = r["_id"].values, r["c_id"].values, r["_twice"].as_py()
            own, theirs = (matrix(r[x].values).astype(np.int64) for x in ("_ls", "c_ls"))
            q, c = matrix(r["_v"].values), matrix(r["c_v"].values)
            equal = _Equal(ids.to_numpy(zero_copy_only=False), c_ids.to_numpy(zero_copy_only=False))
            (own_found, own_ends, mine), (found, ends, member) = _membership(own), _membership(theirs)
            sums, counts = np.zeros((len(q), ends[-1])), np.tile(member.sum(axis=0), (len(q), 1))
            back, back_counts = np.zeros((len(c), own_ends[-1])), np.tile(mine.sum(axis=0), (len(c), 1))
            tiles = [(t, euclidean(c[t:t + WIDE])) for t in range(0, len(c), WIDE)]
            for s in range(0, len(q), TALL):
                part, (i, j) = q[s:s + TALL], equal.of(s, s + TALL)
                np.subtract.at(counts, i + s, member[j])
                if twice:
                    np.subtract.at(back_counts, j, mine[i + s])
                for t, between in tiles:
                    d = between(part)
                    if len(i):
                        here = (j >= t) & (j < t + WIDE)
                        d[i[here], j[here] - t] = 0.0
                    sums[s:s + TALL] += d @ member[t:t + WIDE]
                    if twice:
                        back[t:t + WIDE] += d.T @ mine[s:s + TALL]
            yield from emit(r, ids, own, found, ends, sums, counts)
            if twice:
                yield from emit(r, c_ids, theirs, own_found, own_ends, back, back_counts)

    return run


def silhouettes(
    df: DataFrame,
    *,
    id_col: str,
    vec_col: str,
    label_cols: Sequence[str],
    cohort: Sequence[str] = (),
    query_block: int = 32768,
    candidate_block: int = 4096,
) -> DataFrame:
    """(cohort..., labelling, silhouette, n_rows, n_clusters): the mean Euclidean silhouette of each label column, all in
    one pass over the distances. Singleton clusters score 0; NULL unless 2 <= clusters <= n - 1.

    Blocks hold about ``query_block`` rows; a small cohort is cut further, to ``candidate_block`` rows at the least."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = list(cohort)
    ck = names or ["_all"]  # one implicit cohort; keeps every join an equi-join
    df = df if names else df.withColumn("_all", F.lit(0))
    labels = F.array(*[F.col(c).cast("long") for c in label_cols])
    base = df.select(*ck, F.col(id_col).alias("_id"), F.lit(0).alias("_copy"), _vec(vec_col).alias("_v"), labels.alias("_ls"))
    blocks = in_blocks(base, ck, query_block, ["_id", "_v", "_ls"], fewest=FEWEST, small=candidate_block)
    first = blocks.withColumnRenamed("_qb", "_one").withColumn("_other", F.explode(F.sequence(F.col("_one"), F.col("_bq") - 1))).drop("_bq")
    second = blocks.withColumnsRenamed({"_qb": "_other", "_id": "c_id", "_v": "c_v", "_ls": "c_ls"})
    second = second.withColumn("_one", F.explode(F.sequence(F.lit(0), F.col("_other")))).drop("_bq")
    pairs = first.join(second, [*ck, "_one", "_other"]).withColumn("_twice", F.col("_one") != F.col("_other")).drop("_one", "_other")
    shape = base.select(*ck, "_id", F.lit(0).alias("_labelling"), F.lit(0).cast("long").alias("_own"), F.lit(0).cast("long").alias("_other"),
                        F.lit(0.0).alias("_sum"), F.lit(0).cast("long").alias("_cnt"))
    sums = pairs.mapInArrow(_distance_sums(ck, to_arrow_schema(shape.schema)), shape.schema)
    means = sums.groupBy(*ck, "_id", "_labelling", "_own", "_other").agg((F.sum("_sum") / F.sum("_cnt")).alias("_mean"))
    per_row = means.groupBy(*ck, "_id", "_labelling", "_own").agg(
        F.max(F.when(F.col("_other") == F.col("_own"), F.col("_mean"))).alias("_a"),
        F.min(F.when(F.col("_other") != F.col("_own"), F.col("_mean"))).alias("_b"),
    )
    s = F.when(F.col("_a").isNull(), F.lit(0.0)).otherwise(
        (F.col("_b") - F.col("_a")) / F.greatest(F.col("_a"), F.col("_b")))
    each = base.select(*ck, F.posexplode("_ls").alias("_labelling", "_l"))
    sizes = each.groupBy(*ck, "_labelling").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_l").alias("n_clusters"))
    agg = per_row.withColumn("_s", s).groupBy(*ck, "_labelling").agg(F.avg("_s").alias("_sil"))
    joined = sizes.join(agg, [*ck, "_labelling"], "left")
    valid = (F.col("n_clusters") >= 2) & (F.col("n_clusters") <= F.col("n_rows") - 1)
    name = F.element_at(F.array(*[F.lit(c) for c in label_cols]), F.col("_labelling") + 1)
    return joined.select(*names, name.alias("labelling"), F.when(valid, F.col("_sil")).alias("silhouette"), "n_rows", "n_clusters")


def silhouette(
    df: DataFrame,
    *,
    id_col: str,
    vec_col: str,
    label_col: str,
    cohort: Sequence[str] = (),
    query_block: int = 32768,
    candidate_block: int = 4096,
) -> DataFrame:
    """(cohort..., silhouette, n_rows, n_clusters) of one label column (see :func:`silhouettes`)."""
    return silhouettes(df, id_col=id_col, vec_col=vec_col, label_cols=[label_col], cohort=cohort,
                       query_block=query_block, candidate_block=candidate_block).drop("labelling")


def cluster_profiles(df: DataFrame, feature_cols: Sequence[str], label_col: str, cohort: Sequence[str] = ()) -> DataFrame:
    """Per cluster its size and the mean of every feature, long form
    (cohort..., label, n, feature, mean) -- the transposed profile table."""
    ck = list(cohort)
    wide = df.groupBy(*ck, label_col).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in feature_cols])
    return wide.unpivot([*ck, label_col, "n"], list(feature_cols), "feature", "mean")
