"""Removal of byte strings that appear earlier, by suffix order and longest-previous-factor arrays.

A byte goes when a string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller id, or in the same one further ahead.
Strings are judged on the input.

How it is spread over a cluster. Every string (window) of ``length`` bytes has a
minimizer: of the hashes of its ``K``-byte parts the smallest, the leftmost of
equals. Neighbouring windows mostly share it, so a text falls into runs of at
most 64 windows with one anchor each, and equal windows always have equal
anchors. Documents are dealt into cells by a hash of their id.

1. Each cell lists its runs, equal ones once, as (anchor hash, hash of the run's
   bytes, document, number of the run) and deals them out by anchor.
2. Runs met with the same anchor are compared. Of equal runs only the first can
   hold first windows: the others are *gone*. First runs with an anchor that
   other runs have too are *asked* for; where an anchor has very many different
   runs, they are asked for window by window.
3. Cells send the bytes of what was asked for, by anchor, or by window hash where
   it is window by window. Within a cell, equal ones are sent once.
4. What meets is sorted into suffix order; common prefixes of neighbours, with
   the previous and next smaller position in that order, give each window's
   longest previous factor. Windows whose factor is as long as they are have an
   earlier copy.
5. Cells gather the answers, cover the removed windows and cut.

Steps 1, 3 and 5 read the same shuffled texts. A passage that a third of all
documents share meets once per cell in step 2, and its ragged ends, all
different, are spread by window hash.

Null text is empty; null ids count as the largest. Rows with equal id and equal
text are one document and both get its result; equal ids with different texts
follow each other in byte order of the text. Texts under ``length`` bytes stay.
Other columns, of whatever name, are carried along."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import n_partitions

MOST_WINDOWS = 64  # of a run, so that its windows fit one 64-bit mask
PIECE = 1 << 20
LAST_ID = (1 << 63) - 1
GONE, ASKED, SINGLY = 1, 2, 3
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUE = _RANDOM.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15
POSITION = np.uint64((1 << 24) - 1)


def _part_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` bytes in a row."""
    n, size = len(data), 1
    h = {1: BYTE_VALUE[data]}
    while size * 2 <= k:
        f = np.uint64(pow(FACTOR, size, 1 << 64))
        h[size * 2] = h[size][: n - 2 * size + 1] * f + h[size][size : n - size + 1]
        size *= 2
    out, have = None, 0
    for size in sorted(h, reverse=True):
        if k - have >= size:
            nxt = h[size][have : have + n - k + 1]
            out = nxt if out is None else out * np.uint64(pow(FACTOR, size, 1 << 64)) + nxt
            have += size
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(27))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size, n = 1, len(values) - width + 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


class Runs:
    """The runs of one cell, in order of document and start."""

    def __init__(self, ids: list[int | None], texts: list[str | None], length: int):
        self.length, self.k = length, length - MOST_WINDOWS + 1
        raw = [(LAST_ID if i is None else i, (t or "").encode()) for i, t in zip(ids, texts)]
        self.docs = sorted(set(raw))
        number = {d: n for n, d in enumerate(self.docs)}
        self.row_doc = [number[r] for r in raw]  # document of each row
        found = [self._of_piece(*p) for p in self._pieces()]
        join = lambda j, kind: np.concatenate([f[j] for f in found]) if found else np.zeros(0, dtype=kind)
        self.doc, self.start, self.size = join(0, np.int64), join(1, np.int64), join(2, np.int64)
        self.anchor, self.content = join(3, np.uint64), join(4, np.uint64)
        order = np.lexsort((np.arange(len(self.doc)), self.content, self.anchor))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (self.anchor[order[1:]] == self.anchor[order[:-1]]) & (self.content[order[1:]] == self.content[order[:-1]])
        self.first = np.ones(len(order), dtype=bool)  # not equal to an earlier run of the cell
        self.first[order[same]] = False

    def _pieces(self):
        """(document numbers, first window starts, byte strings) of about PIECE bytes; longer texts in several."""
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for n, (_, data) in enumerate(self.docs):
            for lo in range(0, len(data) - self.length + 1, PIECE):
                part = data[lo : lo + PIECE + self.length - 1]
                if size + len(part) > PIECE and held[0]:
                    yield held
                    held, size = ([], [], []), 0
                for h, v in zip(held, (n, lo, part)):
                    h.append(v)
                size += len(part)
        if held[0]:
            yield held

    def _of_piece(self, numbers: list[int], starts: list[int], parts: list[bytes]):
        whole = b"".join(parts)
        sizes = np.array([len(p) for p in parts])
        begin = np.cumsum(sizes) - sizes
        hashes = _part_hashes(np.frombuffer(whole, dtype=np.uint8), self.k)
        keys = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
        at = (_sliding_least(keys, MOST_WINDOWS) & POSITION).astype(np.int64)
        n = len(at)
        valid = np.zeros(n + 1, dtype=np.int8)
        np.add.at(valid, begin, 1)
        np.add.at(valid, np.minimum(begin + sizes - self.length + 1, n), -1)
        valid = np.cumsum(valid[:n]).astype(bool)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        new[begin] = True
        head = np.flatnonzero(new)
        stop = np.append(head[1:], n)
        part = np.searchsorted(begin, head, side="right") - 1
        stop = np.minimum(stop, (begin + sizes - self.length + 1)[part])
        view, extra, digest = memoryview(whole), self.length - 1, xxhash.xxh3_64_intdigest
        content = np.fromiter((digest(view[a : b + extra]) for a, b in zip(head.tolist(), stop.tolist())), dtype=np.uint64, count=len(head))
        return (
            np.array(numbers, dtype=np.int64)[part],
            head - begin[part] + np.array(starts, dtype=np.int64)[part],
            stop - head,
            hashes[at[head]],
            content,
        )

    def bytes_of(self, run: int) -> bytes:
        lo = int(self.start[run])
        return self.docs[int(self.doc[run])][1][lo : lo + int(self.size[run]) + self.length - 1]

    def windows_of(self, run: int) -> list[bytes]:
        data = self.bytes_of(run)
        return [data[i : i + self.length] for i in range(int(self.size[run]))]

    def single_windows(self, runs: np.ndarray):
        """(run, offset, 128-bit hash, bytes, whether first in the cell) of all windows of runs asked for singly."""
        seen: set[bytes] = set()
        for run in np.sort(runs).tolist():
            for offset, window in enumerate(self.windows_of(run)):
                digest = xxhash.xxh3_128_digest(window)
                yield run, offset, digest, window, digest not in seen
                seen.add(digest)

    def cut(self, gone: np.ndarray, masks: list[tuple[int, int]]) -> list[tuple[int, int, int, bytes]]:
        """(bytes, bytes removed, removed stretches, bytes left) of each document. ``gone``: whole runs; ``masks``: (run, windows)."""
        sizes = np.array([len(d) for _, d in self.docs], dtype=np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1  # one byte between documents
        edge = np.zeros(int(sizes.sum()) + len(sizes) + 1, dtype=np.int32)
        at = begin[self.doc] + self.start if len(self.doc) else np.zeros(0, dtype=np.int64)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + self.size[gone] + self.length - 1, -1)
        single = [at[run] + i for run, mask in masks for i in range(mask.bit_length()) if mask >> i & 1]
        np.add.at(edge, np.array(single, dtype=np.int64), 1)
        np.add.at(edge, np.array(single, dtype=np.int64) + self.length, -1)
        removed = np.cumsum(edge) > 0
        turn = np.diff(removed.astype(np.int8), prepend=0) == 1
        out = []
        for (_, data), lo, size in zip(self.docs, begin.tolist(), sizes.tolist()):
            off = removed[lo : lo + size]
            n = int(off.sum())
            left = data if not n else np.frombuffer(data, dtype=np.uint8)[~off].tobytes()
            out.append((size, n, int(turn[lo : lo + size].sum()), left))
        return out


# -- suffix order -----------------------------------------------------------


def longest_previous(order: list[int], common: list[int]) -> list[int]:
    """Longest previous factor of each position, from suffix order and the common prefix of each suffix with the one
    before it in that order. What leaves the stack has met its next smaller position; what lies below it is its previous one."""
    out, stack = [0] * len(order), []
    for position, prefix in zip([*order, -1], [*common, 0]):
        while stack and position < stack[-1][0]:
            p, below = stack.pop()
            out[p] = max(below, prefix)
            prefix = min(below, prefix)
        stack.append((position, prefix))
    return out


def seen_before(windows: list[bytes]) -> np.ndarray:
    """Which windows, all of one length, equal an earlier one."""
    n, length = len(windows), len(windows[0])
    order = sorted(range(n), key=windows.__getitem__)  # positions of equal windows keep their order
    common = np.zeros(n, dtype=np.int64)
    for lo in range(1, n, 1 << 16):
        part = np.frombuffer(b"".join(windows[i] for i in order[lo - 1 : lo + (1 << 16)]), dtype=np.uint8).reshape(-1, length)
        differ = part[1:] != part[:-1]
        common[lo : lo + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return np.array(longest_previous(order, common.tolist())) >= length


# -- the five steps ---------------------------------------------------------

_LISTED = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("id", "<i8"), ("run", "<u4")])
_SENT = np.dtype([("key", "<u8"), ("id", "<i8"), ("run", "<u4"), ("offset", "u1"), ("n", "u1")])
_MASK = np.dtype([("run", "<u4"), ("mask", "<u8")])
_ANSWER = np.dtype([("run", "<u4"), ("code", "u1")])
_DEALT = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_DEALT_DDL = "bucket int, cell int, kind int, payload binary"


def _columns(table: np.ndarray) -> bytes:
    """A structured array column by column, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(table[name]).tobytes() for name in table.dtype.names)


def _records(payload: bytes, kind: np.dtype, n: int) -> np.ndarray:
    out, at = np.empty(n, dtype=kind), 0
    for name in kind.names:
        size = kind[name].itemsize * n
        out[name] = np.frombuffer(payload, dtype=kind[name], count=n, offset=at)
        at += size
    return out


def _dealt(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _DEALT)], schema=_DEALT)


def _by(values: np.ndarray):
    """(value, indices) of equal values."""
    order = np.argsort(values, kind="stable")
    edges = np.flatnonzero(np.diff(values[order])) + 1
    for group in np.split(order, edges):
        if len(group):
            yield int(values[group[0]]), group


def remove_repeats(docs: DataFrame, length: int = 100, many: int = 2048, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Each row's other columns as struct ``row``, with n_bytes, n_removed, n_spans and the bytes left (``kept``;
    ``as_text``: what whole characters they hold).

    ``many``: different runs of one anchor from which on they are compared window by window."""
    if length <= MOST_WINDOWS:
        raise ValueError(f"length must be above {MOST_WINDOWS}")
    spark = docs.sparkSession
    n_cells = n_buckets = 2 * n_partitions(spark)  # each cell makes a row for each bucket
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    source = docs.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_cells)).cast("int").alias("cell"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*others).alias("row"),
    )
    cells = source.groupBy("cell")

    def runs_of(table: pa.Table) -> Runs:
        return Runs(table.column("id").to_pylist(), table.column("text").to_pylist(), length)

    def list_runs(table: pa.Table) -> pa.Table:
        cell, runs = table.column("cell")[0].as_py(), runs_of(table)
        own = np.flatnonzero(runs.first)
        listed = np.empty(len(own), dtype=_LISTED)
        listed["anchor"], listed["content"], listed["run"] = runs.anchor[own], runs.content[own], own
        listed["id"] = np.array([i for i, _ in runs.docs], dtype=np.int64)[runs.doc[own]]
        return _dealt([(b, cell, len(g), _columns(listed[g])) for b, g in _by((listed["anchor"] % np.uint64(n_buckets)).astype(np.int64))])

    def answer(table: pa.Table) -> pa.Table:
        """``kind`` carries the number of records here."""
        origin, sizes = table.column("cell").to_numpy(), table.column("kind").to_numpy()
        met = np.concatenate([_records(p, _LISTED, int(n)) for p, n in zip(table.column("payload").to_pylist(), sizes)])
        cell = np.repeat(origin, sizes)
        order = np.lexsort((met["run"], met["id"], met["content"], met["anchor"]))
        met, cell = met[order], cell[order]
        anchor_new = np.append(True, met["anchor"][1:] != met["anchor"][:-1])
        run_new = anchor_new | np.append(True, met["content"][1:] != met["content"][:-1])
        anchor = np.cumsum(anchor_new) - 1
        different = np.bincount(anchor, weights=run_new)[anchor]  # runs that differ, of the record's anchor
        code = np.where(~run_new, GONE, np.where(different > many, SINGLY, np.where(different > 1, ASKED, 0))).astype(np.uint8)
        told = np.flatnonzero(code)
        out = np.empty(len(told), dtype=_ANSWER)
        out["run"], out["code"] = met["run"][told], code[told]
        return _dealt([(0, c, len(g), _columns(out[g])) for c, g in _by(cell[told].astype(np.int64))])

    def answers_in(table: pa.Table) -> np.ndarray:
        return np.concatenate([np.empty(0, dtype=_ANSWER), *(_records(p, _ANSWER, n) for p, n in zip(table.column("payload").to_pylist(), table.column("kind").to_pylist()))])

    def send(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows or not texts.num_rows:
            return _dealt([])
        cell, runs, answers = texts.column("cell")[0].as_py(), runs_of(texts), answers_in(told)
        ids = [i for i, _ in runs.docs]
        sent, data = [], []
        for run in np.sort(answers["run"][answers["code"] == ASKED]).tolist():
            sent.append((runs.anchor[run], ids[runs.doc[run]], run, 0, runs.size[run]))
            data.append(runs.bytes_of(run))
        for run, offset, digest, window, first in runs.single_windows(answers["run"][answers["code"] == SINGLY]):
            if first:
                sent.append((int.from_bytes(digest[:8], "little"), ids[runs.doc[run]], run, offset, 1))
                data.append(window)
        # what is known of the cell goes along, to reach step 5 by the same shuffle
        rows = [(cell % n_buckets, cell, -len(answers), _columns(answers))]
        table = np.array(sent, dtype=_SENT)
        for b, g in _by((table["key"] % np.uint64(n_buckets)).astype(np.int64)):
            rows.append((b, cell, len(g), _columns(table[g]) + b"".join(data[i] for i in g.tolist())))
        return _dealt(rows)

    def compare(table: pa.Table) -> pa.Table:
        """``kind``: the number of records, below zero for answers that are only passed on."""
        rows, keys, where = [], [], []
        for cell, n, payload in zip(*(table.column(c).to_pylist() for c in ("cell", "kind", "payload"))):
            if n < 0:
                rows.append((0, cell, n, payload))
                continue
            sent, at = _records(payload, _SENT, n), _SENT.itemsize * n
            for key, id_, run, offset, size in sent.tolist():
                keys.append(key)
                where.append((id_, run, offset, size, cell, payload[at : at + size + length - 1]))
                at += size + length - 1
        masks: dict[int, list[tuple[int, int]]] = {}
        for _, group in _by(np.array(keys, dtype=np.uint64)):
            if len(group) == 1:
                continue
            met = sorted(where[i] for i in group.tolist())
            windows = [data[i : i + length] for *_, size, _, data in met for i in range(size)]
            seen = seen_before(windows)
            ends = np.cumsum([m[3] for m in met]).tolist()
            for (_, run, offset, _, cell, _), (lo, hi) in zip(met, pairwise([0, *ends])):
                if seen[lo:hi].any():
                    mask = sum(1 << i for i in np.flatnonzero(seen[lo:hi]).tolist()) << offset
                    masks.setdefault(cell, []).append((run, mask))
        for cell, found in masks.items():
            rows.append((0, cell, len(found), _columns(np.array(found, dtype=_MASK))))
        return _dealt(rows)

    out_schema = StructType([source.schema["row"], *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", StringType() if as_text else BinaryType())])

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        runs = runs_of(texts)
        gone, masks = ~runs.first, []
        for n, payload in zip(told.column("kind").to_pylist(), told.column("payload").to_pylist()):
            if n < 0:
                answers = _records(payload, _ANSWER, -n)
                gone[answers["run"][answers["code"] == GONE]] = True
                masks += [(run, 1 << offset) for run, offset, _, _, first in runs.single_windows(answers["run"][answers["code"] == SINGLY]) if not first]
            else:
                masks += _records(payload, _MASK, n).tolist()
        cut = runs.cut(gone, masks)
        rows = [cut[d] for d in runs.row_doc]
        counts = {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("n_bytes", "n_removed", "n_spans"))}
        if as_text:
            kept = pa.array([r[3].decode(errors="ignore") for r in rows], pa.string())
        else:
            kept = pa.array([r[3] for r in rows], pa.binary())
        return pa.table({"row": texts.column("row"), **counts, "kept": kept})

    listed = cells.applyInArrow(list_runs, _DEALT_DDL)
    answers = listed.groupBy("bucket").applyInArrow(answer, _DEALT_DDL)
    sent = cells.cogroup(answers.groupBy("cell")).applyInArrow(send, _DEALT_DDL)
    compared = sent.groupBy("bucket").applyInArrow(compare, _DEALT_DDL)
    return cells.cogroup(compared.groupBy("cell")).applyInArrow(finish, out_schema)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns in their order, with repeats cut from the text.

    Of a character that is cut in part, nothing stays. Null text becomes empty."""
    done = remove_repeats(docs, length=length, id_col=id_col, text_col=text_col, as_text=True)
    return done.select(*[F.col("kept" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])
