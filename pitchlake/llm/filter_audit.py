"""How filters interact: contingency tensors and their contractions.

Every document fails or passes each of five filters, so the documents of a part are
counted in a 2 x 2 x 2 x 2 x 2 tensor (0 passes, 1 fails; an axis per filter), once
for all documents and once for each label. For any order of the filters, the
documents that step k removes are the contraction of the tensor with (1, 0) along
the axes of the filters before, (0, 1) along the step's own and (1, 1) along those
after. One einsum takes all orders and steps of a part; only counts leave the scan.

Four filters look at the text. The fifth fails a text that a smaller id has too: per
digest of the text the smallest id is found by a grouped minimum, and the documents
that hold it are met again by digest and id, so many copies of one text spread by id.

Null texts are empty, a null part is the empty string. Rows without an id have no
labels, fail the fifth filter never and make no other row fail. A repeated row counts
each time; copies under the same id do not fail each other. An id with several labels
has one where any says so. Other columns are not read. An empty table gives no rows."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows, written

FILTERS = "ABCDE"
#: all orders of the filters
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORD_BREAK = r"[\x20\x09-\x0D]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> Column:
    """Bits of the four filters that look at one text: A is 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals, length = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"), F.char_length(text).cast("long")
    fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * length, text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, pattern (0 to 31; bit i: fails filter i), and how many documents: n, good, toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("base"))
    # repeated rows become one with their number before anything is joined
    each = written(base.groupBy("doc_id", "part", "digest", "base").agg(F.count(F.lit(1)).alias("n")), "audit")
    named, nameless = each.filter("doc_id IS NOT NULL"), each.filter("doc_id IS NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    judged = named.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    pattern = F.col("base") + F.when(F.col("first"), 0).otherwise(16)
    judged = judged.select("part", pattern.alias("pattern"), "n", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = nameless.select("part", F.col("base").alias("pattern"), "n", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return judged.unionByName(nameless).groupBy("part", "pattern").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _selectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step: the filter, and vectors that select along each axis what is removed, and what is kept."""
    steps = [(order, k) for order in ORDERS for k in range(len(FILTERS))]
    own = np.array([FILTERS.index(order[k]) for order, k in steps])
    removed = np.ones((len(steps), len(FILTERS), 2), dtype=np.int64)
    for i, (order, k) in enumerate(steps):
        removed[i, [FILTERS.index(f) for f in order[:k]]] = (1, 0)
    kept = removed.copy()
    at = np.arange(len(steps))
    removed[at, own] = (0, 1)
    kept[at, own] = (1, 0)
    return own, removed, kept


def contract(tensor: np.ndarray, select: np.ndarray) -> np.ndarray:
    """``tensor`` (measure, a, b, c, d, e) along each row of ``select`` (row, axis, 2): (measure, row)."""
    a, b, c, d, e = (select[:, i] for i in range(5))
    return np.einsum("mabcde,ka,kb,kc,kd,ke->mk", tensor, a, b, c, d, e)


def measures(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of every order and step from the tensors (all, good, toxic) of a part."""
    own, removed, kept = _selectors()
    lost, good, toxic = contract(tensor, removed)
    alone, fails = np.zeros((5, 5, 2), dtype=np.int64), np.ones((5, 5, 2), dtype=np.int64)
    alone[:, :] = (1, 0)
    alone[np.arange(5), np.arange(5)] = fails[np.arange(5), np.arange(5)] = (0, 1)
    everything = tensor[:1]
    shapley = np.zeros(5, dtype=np.int64)
    np.add.at(shapley, own, lost)
    return {
        "kept": contract(everything, kept)[0], "removed": lost, "redundant": contract(everything, fails)[0][own] - lost,
        "unique_fails": contract(everything, alone)[0][own], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[own],
    }


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step. A part is one row of at most 32 counts a tensor."""
    cells = patterns(docs, labels, part_col, id_col, text_col).groupBy("part").agg(F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("cells"))
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((m, pa.int64()) for m in MEASURES)])
    orders = [order for order in ORDERS for _ in FILTERS]
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))

    def run(batches):
        for part, counted in rows(batches, "part", "cells"):
            flat = np.zeros((3, 32), dtype=np.int64)
            for c in counted:
                flat[:, c["pattern"]] = c["n"], c["good"], c["toxic"]
            # bit 0 of a pattern is the last axis of the reshaped tensor
            found = measures(flat.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1))
            columns = [pa.array([part] * len(orders)), pa.array(orders), pa.array(steps), *(pa.array(found[m]) for m in MEASURES)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return cells.mapInArrow(run, ddl)
