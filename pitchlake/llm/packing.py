"""Packing by bounded-space online best fit.

Every partition keeps at most ``open_windows`` unfinished windows. A document's
ids are cut at the window size; what is left goes into the open window that it
fills best. When it fits none and no further window may be opened, the fullest
one is topped up with the head of the document and emitted, and the rest is
placed in the same way. At the end of a partition the unfinished windows are
merged into full ones; at most one unfinished window a partition is left, and
those are merged in groups of ``merge_group`` partitions. What then remains is
cut at powers of two, which need no padding.

Null and empty texts hold just the end id. Null ids are carried as they are, repeated
rows are packed each on its own, and columns other than id and text are not read, so
their names cannot clash. An empty table gives no pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, id_text, written
from .tokens import encoded

PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
HELD_DDL = "part int, place int, doc_id long, start long, doc_tokens long, ids binary"

#: (doc_id, start, ids, doc_tokens): a stretch of one document's ids
Stretch = tuple[int | None, int, np.ndarray, int]


class OpenWindows:
    """The open windows of one partition. ``place`` yields the windows that are finished."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[int] = []
        self.held: list[list[Stretch]] = []

    def _put(self, i: int, piece: Stretch) -> list[Stretch] | None:
        self.held[i].append(piece)
        self.free[i] -= len(piece[2])
        if self.free[i]:
            return None
        done = self.held[i]
        self.free[i], self.held[i] = self.free[-1], self.held[-1]
        self.free.pop()
        self.held.pop()
        return done

    def place(self, piece: Stretch) -> Iterator[list[Stretch]]:
        doc_id, start, ids, total = piece
        while len(ids):
            need = len(ids)
            fits = [f for f in self.free if f >= need]
            if fits:
                cut, at = need, self.free.index(min(fits))
            elif len(self.free) < self.most:
                self.free.append(self.size)
                self.held.append([])
                cut, at = need, len(self.free) - 1
            else:
                cut = min(self.free)
                at = self.free.index(cut)
            if done := self._put(at, (doc_id, start, ids[:cut], total)):
                yield done
            start, ids = start + cut, ids[cut:]

    def rest(self) -> list[Stretch]:
        """What unfinished windows hold, the fullest first."""
        order = sorted(range(len(self.free)), key=self.free.__getitem__)
        return [p for i in order for p in self.held[i]]


def filled(stretches: list[Stretch], sizes: Iterator[int]) -> Iterator[list[Stretch]]:
    """Windows of the given sizes, filled in order by cutting; the last may be short."""
    room, window = next(sizes, 0), []
    for doc_id, start, ids, total in stretches:
        while len(ids):
            cut = min(room, len(ids))
            window.append((doc_id, start, ids[:cut], total))
            start, ids, room = start + cut, ids[cut:], room - cut
            if not room:
                yield window
                room, window = next(sizes, 0), []
    if window:
        yield window


def powers(n: int, size: int) -> Iterator[int]:
    """``n`` as windows of ``size`` and then falling powers of two."""
    while n >= size:
        yield size
        n -= size
    while n:
        yield (power := 1 << (n.bit_length() - 1))
        n -= power


def described(window: list[Stretch], sequence_id: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in window:
        yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence_id, offset
        offset += len(ids)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, open_windows: int = 64, merge_group: int = 64, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    held_schema = pa.schema([*PIECE, ("part", pa.int32()), ("place", pa.int32()), ("ids", pa.binary())])

    def packed(batches):
        part = TaskContext.get().partitionId()

        def out():
            open_, n = OpenWindows(window, open_windows), 0
            for doc_id, ids in encoded(batches, tokenizer, end_id):
                total, whole = len(ids), len(ids) // window * window
                for start in range(0, whole, window):
                    yield from ((*r, None, None, None) for r in described([(doc_id, start, ids[start : start + window], total)], part << 32 | n))
                    n += 1
                for done in open_.place((doc_id, whole, ids[whole:], total)):
                    yield from ((*r, None, None, None) for r in described(done, part << 32 | n))
                    n += 1
            rest = open_.rest()
            n_rest = sum(len(p[2]) for p in rest)
            for i, w in enumerate(filled(rest, iter([window] * (n_rest // window) + [window]))):
                if i < n_rest // window:
                    yield from ((*r, None, None, None) for r in described(w, part << 32 | n))
                    n += 1
                else:
                    for place, (doc_id, start, ids, total) in enumerate(w):
                        yield doc_id, start, len(ids), None, total, None, None, part, place, ids.astype("<u4").tobytes()

        yield from batched(out(), held_schema)

    def merged(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["part", "place"])
        stretches = [(None if pd.isna(d) else int(d), int(s), np.frombuffer(b, dtype="<u4"), int(t)) for d, s, t, b in zip(held["doc_id"], held["start"], held["doc_tokens"], held["ids"])]
        sizes = powers(sum(len(p[2]) for p in stretches), window)
        base = 1 << 62 | int(key[0]) << 32
        found = [r for i, w in enumerate(filled(stretches, sizes)) for r in described(w, base | i)]
        return pd.DataFrame(found, columns=PIECE.names).astype({"doc_id": "Int64"})

    rows = written(id_text(docs, id_col, text_col).mapInArrow(packed, PIECE_DDL + ", part int, place int, ids binary"), "pack")
    done = rows.filter(F.col("part").isNull()).select(*PIECE.names)
    left = rows.filter(F.col("part").isNotNull()).select("part", "place", "doc_id", "start", "doc_tokens", "ids")
    return done.unionByName(left.groupBy(F.floor(F.col("part") / merge_group)).applyInPandas(merged, PIECE_DDL))
