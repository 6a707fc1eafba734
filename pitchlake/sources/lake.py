"""Lake layout, partitioned reads and writes.

Layout (all Hive-style partitions, so Catalyst prunes them):

* bronze pitches:      ``<root>/year=YYYY/date=YYYY-MM-DD/*.parquet``
* leaderboards:        ``<root>/<dataset>/year=YYYY/*.parquet``
* silver / gold:       ``<root>/role=<role>/year=YYYY/*.parquet``
* metadata (JSON):     ``<root>/role=<role>/year=YYYY/*.json``

Writes use dynamic partition overwrite: re-running a window replaces exactly
the partitions it produced and leaves the rest of the lake untouched.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import short_lived_shuffles

# Leaderboard dataset names.
SPRINT_DATASET = "sprint_speed"
DEFENCE_DATASETS = ("oaa", "outfield_catch_prob", "arm_strength", "catcher_poptime", "catcher_framing", "fielding")


def join_path(root: str, *parts: str) -> str:
    root = root.rstrip("/")
    return "/".join([root, *[p.strip("/") for p in parts if p]])


def date_window(start_date: str, end_date: str) -> tuple[dt.date, dt.date]:
    """Two ISO days as dates; ValueError where one is no date or they are out of order."""
    start, end = (dt.datetime.strptime(d, "%Y-%m-%d").date() for d in (start_date, end_date))
    if start > end:
        raise ValueError(f"the window {start_date} .. {end_date} ends before it begins")
    return start, end


def bronze_day_path(root: str, day: dt.date) -> str:
    return join_path(root, f"year={day.year}", f"date={day.isoformat()}")


def role_year_path(root: str, role: str, year: int) -> str:
    return join_path(root, f"role={role}", f"year={int(year)}")


def leaderboard_path(root: str, dataset: str, year: int | None = None) -> str:
    return join_path(root, dataset, f"year={int(year)}") if year is not None else join_path(root, dataset)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def has_partitions(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` holds partition folders (``name=value``)."""
    if not _exists(spark, root):
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return any("=" in f.getPath().getName() for f in found)


def read_parquet_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """S3: a missing path means "no table" (None); other errors raise."""
    if not _exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


FILE_ORDER = "file_order"
#: where a row stood when it was delivered; landing keeps it in bronze
DELIVERED = "_delivered"


def with_delivery(df: DataFrame) -> DataFrame:
    """Adds ``_delivered``: when a row's file came, the file, the block and the row's place in it.

    ``df`` must come straight from a file reader. Landing shuffles rows, so their order in a bronze file says
    nothing; this column does, and stays with them."""
    row = F.monotonically_increasing_id()  # rises within a block
    return df.withColumn(DELIVERED, F.struct(
        F.col("_metadata.file_modification_time").alias("came"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), row.alias("row")))


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds ``file_order``: where a row stands in load order.

    The file's path comes first (it names the day, so later days come after earlier ones); of one day, rows go by
    ``_delivered`` where the table has it (rows from before that column come first), then by their place in the file.
    ``df`` must come straight from a Parquet reader."""
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if DELIVERED not in df.columns:
        return df.withColumn(FILE_ORDER, F.struct(path.alias("path"), row.alias("row")))
    folder = F.regexp_replace(path, "[^/]*$", "")
    return df.withColumn(FILE_ORDER, F.struct(folder.alias("folder"), F.col(DELIVERED).alias("delivered"), path.alias("path"), row.alias("row")))


def with_short_order(df: DataFrame) -> DataFrame:
    """``file_order`` with the ranks of its folders and files instead of their names: the same order in a few numbers, for
    steps that shuffle and sort by it. The names of the files that rows came from are collected and broadcast."""
    spark, order = df.sparkSession, F.col(FILE_ORDER)
    parts = df.schema[FILE_ORDER].dataType.names
    came = order["delivered"] if "delivered" in parts else None
    named = {"_path": order["path"], **({} if came is None else {"_came": came["path"]})}
    out = df.withColumns(named)
    for name in named:
        found = sorted(r[0] for r in df.select(named[name].alias(name)).where(F.col(name).isNotNull()).distinct().collect())
        folders = [n[: n.rfind("/") + 1] for n in found]
        at = {n: i for i, n in enumerate(sorted(set(folders)))}
        ranks = spark.createDataFrame([(n, i, at[f]) for i, (n, f) in enumerate(zip(found, folders))], f"{name} string, {name}_rank int, {name}_folder int")
        out = out.join(F.broadcast(ranks), name, "left")
    short = {"folder": F.col("_path_folder"), "path": F.col("_path_rank"), "row": order["row"]}
    if came is not None:
        ranked = F.struct(came["came"].alias("came"), F.col("_came_rank").alias("path"), came["block"].alias("block"), came["row"].alias("row"))
        short["delivered"] = F.when(came.isNotNull(), ranked)
    return out.withColumn(FILE_ORDER, F.struct(*[short[p].alias(p) for p in parts])).select(*df.columns)


def read_partitioned(spark: SparkSession, root: str, schema=None, *, merge_schema: bool = True) -> DataFrame:
    """Partitioned read; the file schemas are united (days, seasons or cohorts
    whose columns differ: absent ones are NULL)."""
    reader = spark.read.option("basePath", root).option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(root)


def read_role(spark: SparkSession, root: str, role: str) -> DataFrame | None:
    """One role's partition tree of a ``role=/year=`` table. Roles carry different
    feature columns, so each is read with its own schema, united over its years
    (``role`` re-added)."""
    path = join_path(root, f"role={role}")
    if not _exists(spark, path):
        return None
    return read_partitioned(spark, path).withColumn("role", F.lit(role))


def read_bronze_range(spark: SparkSession, root: str, start: dt.date, end: dt.date) -> DataFrame | None:
    """All bronze days in [start, end], with ``file_order``; missing days simply
    contribute nothing, and a column that only some days carry is NULL on the others.

    The predicate is on the partition columns, so only matching ``date=``
    folders are listed and read (``PartitionFilters`` in the plan).
    """
    if not _exists(spark, root):
        return None
    df = with_file_order(read_partitioned(spark, root))
    date_col = "date" if "date" in df.columns else "game_date"
    out = df.where(
        F.col("year").between(start.year, end.year)
        & F.col(date_col).cast("date").between(F.lit(start), F.lit(end))
    )
    if "game_date" not in out.columns and "date" in out.columns:
        out = out.withColumn("game_date", F.col("date").cast("date"))
    return out


def read_leaderboard_years(spark: SparkSession, root: str, dataset: str, first_year: int, last_year: int) -> DataFrame | None:
    """A yearly leaderboard over a year range, with ``file_order`` (missing years skipped)."""
    path = leaderboard_path(root, dataset)
    if not _exists(spark, path):
        return None
    return with_file_order(read_partitioned(spark, path)).where(F.col("year").between(first_year, last_year))


def write_partitioned(
    df: DataFrame,
    root: str,
    partition_cols: Sequence[str],
    *,
    compression: str = "snappy",
    fmt: str = "parquet",
    observe: Mapping[str, Column] | None = None,
    clustered: bool = False,
) -> dict[str, Any]:
    """Dynamic partition overwrite; gives the ``observe`` aggregates over the written rows.

    Rows are clustered by the partition columns with the ``rebalance`` hint: each
    output partition is written by few tasks (no small-file explosion), and AQE
    splits a skewed one (a day or season holding a large share of the rows)
    over several tasks instead of funnelling it through one. Aggregates are taken
    by the writing tasks, beyond the last shuffle, so a repeated stage counts no row twice.
    ``clustered`` rows (read from a table of the same layout) are written without a shuffle.
    """
    rows, seen = df if clustered else df.hint("rebalance", *partition_cols), Observation()
    if observe:
        rows = rows.observe(seen, *[c.alias(name) for name, c in observe.items()])
    writer = (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")  # per write: safe with concurrent jobs
        .option("compression", compression)
        .partitionBy(*partition_cols)
        .format(fmt)
    )
    with short_lived_shuffles(df.sparkSession):
        writer.save(root)
    return dict(seen.get) if observe else {}


def drop_file_partition_columns(df: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    """A file that also stores a partition column gets that column dropped
    before writing, so partition discovery does not clash with it."""
    return df.drop(*[c for c in partition_cols if c in df.columns])


def write_metadata(spark: SparkSession, root: str, records: Sequence[dict], partition_cols: Sequence[str] = ("role", "year")) -> None:
    """One JSON document per cohort, with a UTC timestamp, partitioned like the data."""
    stamp = dt.datetime.now(dt.timezone.utc).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    rows = []
    for rec in records:
        body = {**rec, "generated_at_utc": stamp}
        rows.append(tuple([rec[c] for c in partition_cols] + [json.dumps(body, sort_keys=True, default=str)]))
    schema = ", ".join([f"{c} string" for c in partition_cols] + ["payload string"])
    meta = spark.createDataFrame(rows, schema)
    write_partitioned(meta.coalesce(1), root, partition_cols, fmt="json")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.json(root)


def load_serving_tables(
    spark: SparkSession,
    *,
    archetypes_root: str,
    neighbors_root: str,
    year: int | None = None,
    roles: Sequence[str] = ("batter", "pitcher"),
) -> tuple[DataFrame, DataFrame]:
    """The two serving tables (assignments, neighbours) of the roles that have
    rows in both. Every role is read from its own folder and named by it, so a
    table without a ``role`` column gets the right one."""
    found: list[tuple[DataFrame, DataFrame]] = []
    for role in roles:
        both = [read_role(spark, root, role) for root in (archetypes_root, neighbors_root)]
        if year is not None:
            both = [t if t is None else t.where(F.col("year") == int(year)) for t in both]
        if all(t is not None and not t.isEmpty() for t in both):
            found.append((both[0], both[1]))
    if not found:
        raise ValueError(f"no role of {tuple(roles)} has both serving tables")
    archetypes, neighbors = found[0]
    for more_a, more_n in found[1:]:
        archetypes = archetypes.unionByName(more_a, allowMissingColumns=True)
        neighbors = neighbors.unionByName(more_n, allowMissingColumns=True)
    return archetypes, neighbors
