"""Exact quantiles per group that no task has to hold.

A group's values are counted first: (group, measure, value, n) is one shuffle with
map-side partial counts on the full key, so a group that holds a third of all rows is
spread by its values. Then

* groups with few distinct values take ``percentile`` over value and count: a small
  buffer each, whatever their number of rows;
* the others are range-partitioned by (group, measure, value). The count of each
  (group, partition) chunk and a running sum over a group's few chunks tell which
  chunk holds each wanted rank; only those chunks are summed value by value. No task
  sees more of a group than one range partition holds.

Both give the linear interpolation ``percentile`` gives, to the last bit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import col_

#: groups of more distinct values than this go by ranks
MOST = 1 << 16
#: distinct values in a range partition, about
LARGEST = 1 << 18


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def value_counts(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str | Column]) -> DataFrame:
    """(keys..., measure, value, n) of every non-null value of every measure."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), col_(c).cast("double").alias("value")) for m, c in measures.items()])).alias("_e")
    long = df.select(*keys, each).select(*keys, "_e.measure", "_e.value").where(F.col("value").isNotNull())
    return long.groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def _by_rank(counts: DataFrame, keys: Sequence[str], probs: Sequence[float], n_rows: int, most: int) -> DataFrame:
    """(keys..., quantiles) by ranks; ``counts`` (keys..., value, n) of groups too large for a buffer."""
    from ..session import cut_lineage

    spark = counts.sparkSession
    # no more than the session's partitions unless they got too large for a task: what a driver keeps of a shuffle grows with their square
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // max(most, LARGEST)))
    ranged = counts.repartitionByRange(parts, *keys, "value").withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # the partition numbers hold from here on
    chunks = ranged.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_part")  # a row a chunk
    chunks = chunks.select(*keys, "_part", "_n", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(position(p)), F.ceil(position(p))) for p in probs])))
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    chunks = chunks.withColumn("_ranks", here).where(F.size("_ranks") > 0).drop("_n")
    inside = match(ranged, chunks, [*keys, "_part"])
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy("value"))
    inside = inside.withColumn("_upto", upto)
    hit = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("n")) & (r < F.col("_upto")))
    found = inside.select(*keys, "_total", "value", F.explode(hit).alias("_rank"))
    found = found.groupBy(*keys, "_total").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_at"))

    def quantile(p: float) -> Column:
        at = position(p)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.col("_at")[low], F.col("_at")[high]
        return F.when(low == high, a).otherwise((high - at) * a + (at - low) * b)

    return found.select(*keys, F.col("_total").alias("n"), F.array(*[quantile(p) for p in probs]).alias("quantiles"))


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Sequence[float], *, most: int = MOST) -> DataFrame:
    """(keys..., measure, n, quantiles) from (keys..., measure, value, n), one row a distinct value."""
    from ..session import cut_lineage

    group = [*keys, "measure"]
    counts = cut_lineage(counts)
    sizes = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_distinct"))
    large = sizes.where(F.col("_distinct") > most)
    n_large, rows = large.agg(F.count(F.lit(1)), F.sum("_distinct")).first()
    few = counts if not n_large else match(counts, large.select(*group), group, "left_anti")
    q = F.percentile(F.col("value"), F.array(*[F.lit(float(p)) for p in probs]), F.col("n"))
    out = few.groupBy(*group).agg(F.sum("n").alias("n"), q.alias("quantiles"))
    if n_large:
        many = match(counts, large.select(*group), group, "left_semi")
        out = out.unionByName(_by_rank(many, group, probs, rows, most))
    return out


def iqr_columns(quantiles: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key: each measure's third less first quartile under the measure's name; NULL below two values."""
    spread = F.col("quantiles")[1] - F.col("quantiles")[0]
    return quantiles.groupBy(*keys).agg(*[F.max(F.when((F.col("measure") == m) & (F.col("n") >= 2), spread)).alias(m) for m in names])


def iqrs(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str | Column], *, most: int = MOST) -> DataFrame:
    """(keys..., one interquartile range per measure)."""
    counted = value_counts(df, keys, measures)
    return iqr_columns(quantiles_of_counts(counted, keys, (0.25, 0.75), most=most), keys, list(measures))
