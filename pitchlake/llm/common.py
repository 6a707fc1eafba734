"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a word: space and the control characters 9 to 13. ``bytes.split()`` splits at just these.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver see (``spark.checkpoint.dir``).

    Where the setting is missing a local session gets a temporary folder; on a
    cluster there is no safe default, so the call fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pitchlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, under fixed names, so other columns can never clash. Null text becomes empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def rows(batches: Iterable[pa.RecordBatch], *names: str, at_once: int = 256) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row; only ``at_once`` rows are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, at_once):
            part = batch.slice(lo, at_once)
            yield from zip(*(part.column(n).to_pylist() for n in names))


def slices(sizes: list[int], most: int, max_bytes: int) -> Iterator[slice]:
    """Runs of at most ``most`` items whose sizes sum to at most ``max_bytes``; a larger item is a run of its own."""
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and (i - lo >= most or held + size > max_bytes):
            yield slice(lo, i)
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield slice(lo, len(sizes))


_REMEMBERS: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Called where an operator begins to fill a memory of this Python worker.

    Spark uses a worker for many tasks; what other operators remembered in it is
    let go, so that a chain of operators holds one memory at a time."""
    others = [o for o in _REMEMBERS if o != owner]
    for other in others:
        _REMEMBERS.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _REMEMBERS[owner] = forget


def batched(records: Iterable[tuple], schema: pa.Schema, size: int = 4096, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows or about ``max_bytes`` of strings and binaries."""
    held, held_bytes = [], 0
    for r in records:
        held.append(r)
        held_bytes += sum(len(v) for v in r if isinstance(v, (bytes, str)))
        if len(held) >= size or held_bytes >= max_bytes:
            yield _batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
