"""Token ids in files: frequency-ranked ids, byte-aligned variable-length code.

Ids are replaced by their frequency rank in the whole corpus, so frequent ones
need one byte. Of every four ranks one control byte holds the four lengths (two
bits each, length less one); control bytes and data bytes are separate streams,
so a reader finds all lengths by one table lookup per control byte.

A folder written by :func:`write` holds

* ``ranks``: rank, token id (at most as many rows as the vocabulary), and
* ``blocks``: per block its shard, number in the shard, ids of the shard before
  it, the documents' ids and lengths, the control bytes and the data bytes.
  Shards and blocks follow ascending document id.

Spark's writer makes the files, so any store that Spark reaches will do, and a
lost task is simply run again. Null texts are empty (end id only), null
document ids come first, repeated rows stay repeated. An empty table gives
empty files."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, id_text, n_partitions, rows, written
from .tokens import encoded, id_kind

#: length of each of the four values of a control byte
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    size = (values >= 1 << 8).astype(np.uint8)
    for bits in (16, 24):
        if values.max(initial=0) >= 1 << bits:
            size += values >= 1 << bits
    size += 1
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = size - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    wide = int(size.max(initial=1))
    data = values.view(np.uint8).reshape(-1, 4)[:, :wide][np.arange(wide, dtype=np.uint8) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    begin = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[begin].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[begin[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids (little endian, as wide as the vocabulary needs), written once.

    Each task adds one row of ``counts`` instead: how often it met each id (64 bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        total = np.zeros(0, dtype=np.int64)

        def out():
            nonlocal total
            held, size = [], 0
            for doc_id, ids in encoded(batches, tokenizer, end_id):
                held.append(ids)
                size += len(ids)
                if size > 1 << 18:
                    total, held, size = _added(total, np.bincount(np.concatenate(held))), [], 0
                yield doc_id, ids.tobytes(), None
            if held:
                total = _added(total, np.bincount(np.concatenate(held)))
            yield None, None, total.tobytes()

        yield from batched(out(), schema)

    return written(id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, counts binary"), "tokens")


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    a = a.copy()
    a[: len(b)] += b
    return a


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Token ids by falling corpus frequency, then by id. As long as the vocabulary at most."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def unpacked(batches):
        total = np.zeros(0, dtype=np.int64)
        for (counts,) in rows(batches, "counts"):
            total = _added(total, np.frombuffer(counts, dtype=np.int64))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], schema=schema)

    counts = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(unpacked, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.array([r.token for r in counts.orderBy(F.desc("n"), "token").select("token").collect()], dtype=np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_tokens: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all documents into the folder ``path``; returns it."""
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer, end_id, id_col, text_col)
    kind = id_kind(tokenizer)
    by_rank = frequency_ranks(tokens)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(by_rank)], "rank long, token long").coalesce(1).write.parquet(f"{path}/ranks")
    schema = pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()),
    ])

    def blocks(batches):
        shard = TaskContext.get().partitionId()

        def out():
            n, start, names, parts, size = 0, 0, [], [], 0
            for doc_id, ids in rows(batches, "doc_id", "ids"):
                names.append(doc_id)
                parts.append(np.frombuffer(ids, dtype=kind))
                size += len(parts[-1])
                if size >= block_tokens:
                    yield shard, n, start, size, names, [len(p) for p in parts], *encode_values(rank_of[np.concatenate(parts)])
                    n, start, names, parts, size = n + 1, start + size, [], [], 0
            if names:
                yield shard, n, start, size, names, [len(p) for p in parts], *encode_values(rank_of[np.concatenate(parts)])

        yield from batched(out(), schema, max_bytes=4 << 20)

    ordered = tokens.filter("ids IS NOT NULL").select("doc_id", "ids").repartitionByRange(n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ddl = "shard int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, control binary, data binary"
    ordered.mapInArrow(blocks, ddl).write.parquet(f"{path}/blocks")
    return path


def _decoded(spark: SparkSession, path: str, last: str, kind: pa.DataType, ddl: str, made) -> DataFrame:
    """doc_id, start, n_tokens and what ``made`` makes of each document's ids."""
    by_rank = np.array([r.token for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per shard
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (last, kind)])

    def decode(batches):
        def out():
            names = ("before", "start", "n_tokens", "doc_ids", "doc_tokens", "control", "data")
            for first, start, n, doc_ids, sizes, control, data in rows(batches, *names):
                ids, lo = by_rank[decode_values(control, data, n)], 0
                for doc_id, size in zip(doc_ids, sizes):
                    yield doc_id, first + start + lo, size, made(ids[lo : lo + size].tobytes())
                    lo += size

        yield from batched(out(), schema)

    return blocks.join(before, "shard").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last} {ddl}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (unsigned 32 bit, little endian) of each document."""
    return _decoded(spark, path, "ids", pa.binary(), "binary", lambda ids: ids)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read`, with the CRC of the ids read back in place of the ids."""
    return _decoded(spark, path, "ids_crc32", pa.int64(), "long", zlib.crc32)
