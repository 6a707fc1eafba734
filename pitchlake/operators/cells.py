"""Metric cells: a tree of bounded groups of rows, with a centre and a radius each.

Rows of a cohort are split again and again: every group with too many rows draws
``fan`` of its vectors (by hash) as centres (fewer where fewer groups will do), and each row goes to the nearest. A group
is known by its path from the root, its centre, and the largest distance of its rows
to that centre, so by the triangle inequality no row of it is nearer to a point x than
``d(x, centre) - radius``. That holds for every metric here.

Each round is one shuffle of the rows of groups still too large, in blocks of about
``block`` rows; a cohort of n rows takes about log(n / rows) / log(fan) rounds, and
each row is compared with ``fan`` centres a round, never with all centres.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: relative slack of bounds, far above what rounding can add up to
SLACK = 1e-9


def _each_dimension(q: np.ndarray, columns: np.ndarray, metric: str, p: float, power: bool = False) -> np.ndarray:
    """Distances of a few rows to all ``columns`` (one row a dimension), summed up a dimension at a time, so that what is
    worked on stays in the processor's cache. With ``power`` Minkowski distances are left as sums of powers."""
    total = np.zeros((len(q), columns.shape[1]), columns.dtype)
    diff = np.empty_like(total)
    order = {"euclidean": 2.0, "manhattan": 1.0}.get(metric, p)
    for j in range(len(columns)):
        np.subtract(q[:, j, None], columns[j], out=diff)
        if metric != "chebyshev" and order == 2:
            np.multiply(diff, diff, out=diff)
        else:
            np.abs(diff, out=diff)
        if metric == "chebyshev":
            np.maximum(total, diff, out=total)
        elif order in (1, 2):
            total += diff
        else:
            total += diff * diff * diff if order == 3 else np.power(diff, order)
    if metric == "chebyshev" or power:
        return total
    return _root(total, order)


def _root(total: np.ndarray, order: float) -> np.ndarray:
    return total if order == 1 else np.sqrt(total) if order == 2 else np.cbrt(total) if order == 3 else np.power(total, 1.0 / order)


def _rows_at_once(columns: int) -> int:
    return max(1, (1 << 18) // max(1, columns))


def pairwise(q: np.ndarray, c: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distance matrix |q| x |c| computed in row chunks (bounded memory)."""
    out, columns = np.empty((q.shape[0], c.shape[0])), np.ascontiguousarray(c.T, dtype=float)
    step = _rows_at_once(c.shape[0])
    for s in range(0, q.shape[0], step):
        out[s:s + step] = _each_dimension(q[s:s + step], columns, metric, p)
    return out


def euclidean(c: np.ndarray):
    """A function for the Euclidean distances of some rows to the rows ``c``, from inner products about their middle.

    Where a distance is so small beside the vectors that digits would be lost, it is taken from the differences."""
    middle = c.mean(axis=0) if len(c) else np.zeros(c.shape[1])
    about = c - middle
    norms = np.einsum("ij,ij->i", about, about)
    columns = np.vstack([-2.0 * about.T, norms, np.ones(len(c))])  # one product gives squared distances

    def run(q: np.ndarray) -> np.ndarray:
        x = q - middle
        own = np.einsum("ij,ij->i", x, x)
        d = np.column_stack([x, np.ones(len(x)), own]) @ columns
        if d.min(initial=np.inf) > 1e-3 * (own.max(initial=0.0) + norms.max(initial=0.0)):
            return np.sqrt(d, out=d)
        i, j = np.nonzero(~(d > 1e-3 * (own + norms.max(initial=0.0))[:, None]))  # also where a number is missing
        lost = ~(d[i, j] > 1e-3 * (own[i] + norms[j]))
        i, j = i[lost], j[lost]
        np.maximum(d, 0.0, out=d)
        np.sqrt(d, out=d)
        d[i, j] = of_pairs(q[i], c[j], "euclidean", 2.0)
        return d

    return run


def of_pairs(q: np.ndarray, c: np.ndarray, metric: str, p: float, at_once: int = 1 << 14) -> np.ndarray:
    """The distance of each row of ``q`` to the same row of ``c``."""
    out = np.empty(len(q))
    order = {"euclidean": 2.0, "manhattan": 1.0}.get(metric, p)
    for s in range(0, len(q), at_once):
        diff = np.abs(q[s:s + at_once] - c[s:s + at_once])
        if metric == "chebyshev":
            out[s:s + at_once] = diff.max(axis=1)
        else:
            powers = diff if order == 1 else diff * diff if order == 2 else diff * diff * diff if order == 3 else np.power(diff, order)
            out[s:s + at_once] = _root(powers.sum(axis=1), order)
    return out


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


class Rough:
    """Distances to the rows ``c`` that may be off by an error and are cheap to get: in single precision, for Euclidean ones
    from inner products. They only decide for which pairs the exact distance is taken."""

    def __init__(self, c: np.ndarray, metric: str, p: float):
        self.metric, self.order = metric, {"euclidean": 2.0, "manhattan": 1.0}.get(metric, p)
        self.euclid = metric != "chebyshev" and self.order == 2
        self.p, self.d, self.largest = p, c.shape[1], _largest(c)
        if self.euclid:
            self.middle = c.mean(axis=0)
            c = c - self.middle
            self.norms = np.einsum("ij,ij->i", c, c)
            self.c = np.vstack([-2.0 * c.T, self.norms, np.ones(len(c))]).astype(np.float32)  # one product gives squared distances
        else:
            self.c = np.ascontiguousarray(c.T, dtype=np.float32)

    def usable(self, q: np.ndarray) -> bool:
        """Whether single precision can hold the powers and inner products do not overflow (never for infinite or missing numbers)."""
        return max(self.largest, _largest(q)) < 1e9 and (self.euclid or self.metric == "chebyshev" or self.order <= 3)

    def to(self, q: np.ndarray, some: slice = slice(None)) -> tuple[np.ndarray, float]:
        """(|q| x |some of c| comparable numbers, error of a distance): the numbers are what :meth:`limit` makes of a distance."""
        scale, eps = max(self.largest, _largest(q)), float(np.finfo(np.float32).eps)
        if self.euclid:
            q = q - self.middle
            norms = np.einsum("ij,ij->i", q, q)
            found = np.column_stack([q, np.ones(len(q)), norms]).astype(np.float32) @ self.c[:, some]
            self._square_error = 16 * (self.d + 4) * eps * (norms.max(initial=0.0) + self.norms.max(initial=0.0))
            return found, 8 * self.d * float(np.finfo(float).eps) * scale
        found = _each_dimension(q.astype(np.float32), self.c[:, some], self.metric, self.p, power=True)
        return found, 16 * self.d * eps * scale

    def limit(self, distance: np.ndarray, error: float) -> np.ndarray:
        """The number that no pair within ``distance`` exceeds."""
        reach = distance + error
        if self.euclid:
            return reach * reach + self._square_error
        reach = reach * (1 + 16 * self.d * float(np.finfo(np.float32).eps))
        return reach if self.metric == "chebyshev" or self.order == 1 else np.power(reach, self.order)

    def reach(self, number: np.ndarray, error: float) -> np.ndarray:
        """A distance that pairs of at most ``number`` do not exceed."""
        number = number.astype(float)
        if self.euclid:
            return np.sqrt(np.maximum(number, 0.0) + self._square_error) + error
        reach = number if self.metric == "chebyshev" else _root(number, self.order)
        return reach * (1 + 16 * self.d * float(np.finfo(np.float32).eps)) + error


class Whole:
    """Manhattan and Chebyshev distances in steps, as 16-bit whole numbers that may be off by ``error``.

    Steps are so wide that no distance of the given rows overflows. Distances only grow with every dimension, so pairs that
    a few dimensions have put beyond their limit are dropped before the others are looked at."""

    def __init__(self, q: np.ndarray, c: np.ndarray, metric: str):
        low, high = np.minimum(q.min(axis=0), c.min(axis=0)), np.maximum(q.max(axis=0), c.max(axis=0))
        self.largest, d = metric == "chebyshev", c.shape[1]
        span = float((high - low).max() if self.largest else (high - low).sum())
        self.scale = (32000 - 2 * d) / span if span > 0 else 1.0
        self.error = (1 if self.largest else d) * 1.001 / self.scale  # each number is off by half a step
        self.q, self.c = (np.rint((x - low) * self.scale).astype(np.int16) for x in (q, c))
        self.c = np.ascontiguousarray(self.c.T)

    @staticmethod
    def fits(q: np.ndarray, c: np.ndarray) -> bool:
        return len(q) > 0 and len(c) > 0 and c.shape[1] < 8000

    def within(self, rows: slice, some: slice, bound: np.ndarray) -> np.ndarray:
        """Flat positions in |rows| x |some| of the pairs that may be within the bound of their row."""
        q, c = self.q[rows], self.c[:, some]
        limit = np.minimum(np.ceil((bound + self.error) * self.scale), 32767).astype(np.int16)[:, None]
        total, diff = np.zeros((len(q), c.shape[1]), np.int16), np.empty((len(q), c.shape[1]), np.int16)
        for j in range(len(c)):
            np.subtract(c[j], q[:, j, None], out=diff)
            np.abs(diff, out=diff)
            (np.maximum if self.largest else np.add)(total, diff, out=total)
            if j % 16 == 15 and j + 1 < len(c):
                left = np.flatnonzero(total <= limit)
                if len(left) * 32 < total.size:
                    return left
        return np.flatnonzero(total <= limit)


class Balls:
    """Minkowski distances (of an order other than 1 and 2) ruled out by Euclidean ones, which are inner products.

    Over d dimensions a Euclidean distance is at most ``d ** (1/2 - 1/p)`` times the one of order p > 2, and at most the one
    of order p < 2, so a Minkowski ball lies in a Euclidean one. Pairs within it are summed up in single precision, and
    where many are (the balls tell little apart), all pairs are, a dimension at a time."""

    #: with more than one pair in so many left by Euclidean distances, sums of all pairs cost less
    LEAST = 12

    def __init__(self, q: np.ndarray, c: np.ndarray, p: float):
        self.p, self.q, d = p, q, c.shape[1]
        self.factor = d ** max(0.0, 0.5 - 1.0 / p) * (1 + SLACK)
        self.euclid, self.sums = Rough(c, "euclidean", 2.0), Rough(c, "minkowski", p)
        self.q32, self.c32 = q.astype(np.float32), np.ascontiguousarray(c, dtype=np.float32)
        self.skip = 0

    @staticmethod
    def fits(q: np.ndarray, c: np.ndarray, p: float) -> bool:
        return p not in (1, 2) and len(q) > 0 and len(c) > 0 and c.shape[1] > 0 and p <= 3 and max(_largest(q), _largest(c)) < 1e9

    def within(self, rows: slice, some: slice, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``rows`` and in ``some`` of the pairs that may be within the bound of their row."""
        q, width = self.q[rows], len(self.c32[some])
        if self.skip:  # the last tile was summed up
            self.skip -= 1
        else:
            about, error = self.euclid.to(q, some)
            limit = np.nextafter(self.euclid.limit(bound * self.factor, error).astype(np.float32), np.float32(np.inf))
            at = np.flatnonzero(about <= limit[:, None])
            if len(at) * self.LEAST <= about.size:
                i, j = np.divmod(at, width)
                return self._summed(i, j, rows, some, bound)
            self.skip = 15
        found = []
        for s in range(0, len(q), 16):
            about, error = self.sums.to(q[s:s + 16], some)
            limit = np.nextafter(self.sums.limit(bound[s:s + 16], error).astype(np.float32), np.float32(np.inf))
            i, j = np.nonzero(about <= limit[:, None])
            found.append((i + s, j))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _summed(self, i: np.ndarray, j: np.ndarray, rows: slice, some: slice, bound: np.ndarray, at_once: int = 1 << 12):
        """Those pairs whose sums of powers leave them open."""
        q, c = self.q32[rows], self.c32[some]
        error = 16 * self.sums.d * float(np.finfo(np.float32).eps) * max(self.sums.largest, _largest(q))
        limit = np.nextafter(self.sums.limit(bound, error).astype(np.float32), np.float32(np.inf))
        kept = np.zeros(len(i), bool)
        for s in range(0, len(i), at_once):
            a, b = i[s:s + at_once], j[s:s + at_once]
            diff = np.abs(q[a] - c[b])
            powers = diff * diff * diff if self.p == 3 else np.power(diff, self.p)
            kept[s:s + at_once] = powers.sum(axis=1) <= limit[a]
        return i[kept], j[kept]


class Boxes:
    """Rows by bit sets: those below each of some cuts, for every dimension.

    All rows within a Chebyshev distance lie in a box, and the rows of a box are what the sets of all dimensions share: a bit a
    row and dimension is looked at, not a number. Sides are moved out to the next cut, so a box may hold more rows, never fewer."""

    CUTS = 128

    def __init__(self, c: np.ndarray):
        n, d = c.shape
        columns = np.ascontiguousarray(c.T)
        self.cuts = np.sort(columns, axis=1)[:, np.arange(1, self.CUTS) * n // self.CUTS]
        self.below = np.zeros((d, self.CUTS + 1, -(-n // 64)), np.uint64)  # below no cut, each cut, and all rows
        under = np.zeros((self.CUTS + 1, 64 * self.below.shape[2]), bool)
        under[-1, :n] = True
        number = np.arange(self.CUTS - 1, dtype=np.uint8)[:, None]
        for j in range(d):
            passed = np.searchsorted(self.cuts[j], columns[j], side="right").astype(np.uint8)
            np.less_equal(passed, number, out=under[1:-1, :n])
            self.below[j] = np.packbits(under, axis=1, bitorder="little").view(np.uint64)
        self.above = ~self.below

    @staticmethod
    def fits(q: np.ndarray, c: np.ndarray) -> bool:
        """Whether the sets are small (34 MB) and enough rows ask to make up for building them."""
        return c.size <= 1 << 21 and len(q) >= 1024 and sys.byteorder == "little"

    def within(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``q``, row) that may be within the bound of their row."""
        reach = (bound + SLACK * (1 + bound + _largest(q)))[:, None]
        low, high = q - reach, q + reach
        held, sets = np.full((len(q), self.below.shape[2]), ~np.uint64(0)), np.empty((len(q), self.below.shape[2]), np.uint64)
        for j, cuts in enumerate(self.cuts):
            held &= np.take(self.below[j], np.searchsorted(cuts, high[:, j], side="right") + 1, axis=0, out=sets, mode="clip")
            held &= np.take(self.above[j], np.searchsorted(cuts, low[:, j], side="right"), axis=0, out=sets, mode="clip")
            if j % 8 == 7 and np.count_nonzero(held) * 32 < held.size:
                break  # distances of what is left are cheaper
        words = np.flatnonzero(held)
        word, bit = np.nonzero(np.unpackbits(held.ravel()[words].view(np.uint8), bitorder="little").reshape(-1, 64))
        i, at = np.divmod(words[word], held.shape[1])
        return i, 64 * at + bit


def distance(a: Column, b: Column, metric: str, p: float) -> Column:
    """The same distance of two array columns, as an expression."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + f(v))
    if metric == "chebyshev":
        return F.array_max(parts)
    power = {"euclidean": 2.0, "manhattan": 1.0}.get(metric, float(p))
    return total(lambda v: v) if power == 1 else F.pow(total(lambda v: F.pow(v, F.lit(power))), F.lit(1.0 / power))


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list of vectors as an array, without Python objects."""
    return np.asarray(vectors.flatten(), dtype=float).reshape(len(vectors), -1)


def each_row(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}


def in_blocks(rows: DataFrame, keys: Sequence[str], block: int, payload: Sequence[str], *also: Column, fewest: int = 1, small: int = 1) -> DataFrame:
    """Rows gathered into blocks of about ``block`` rows a key: (keys..., _qb, _bq blocks of the key, each payload as a list).

    A key gets ``fewest`` blocks at least, or as many as hold about ``small`` rows each."""
    n = F.count(F.lit(1))
    enough = F.greatest(F.ceil(n / F.lit(block)), F.least(F.lit(fewest).cast("long"), F.ceil(n / F.lit(small))))
    sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(1).cast("long"), enough).cast("int").alias("_bq"))
    placed = rows.join(sizes, list(keys)).withColumn("_qb", F.pmod(F.xxhash64("_id", "_copy"), F.col("_bq")).cast("int"))
    held = placed.groupBy(*keys, "_qb", "_bq").agg(F.collect_list(F.struct(*payload)).alias("_rows"), *also)
    kept = [c for c in held.columns if c != "_rows"]
    return held.select(*kept, *[F.col(f"_rows.{c}").alias(c) for c in payload])


def _nearest(metric: str, p: float):
    """For Arrow batches with _v (vectors) and _centres: the nearest centre of each row and its distance."""

    def run(batches):
        for batch in batches:
            slots, reaches = [], []
            for r in each_row([batch.select(["_v", "_centres"])]):
                d = pairwise(matrix(r["_v"].values), matrix(r["_centres"].values), metric, p)
                slot = d.argmin(axis=1)
                slots.append(pa.array(slot, pa.int32()))
                reaches.append(pa.array(d[np.arange(len(slot)), slot]))
            lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(s) for s in x])].astype(np.int32), pa.concat_arrays(x)) for x in (slots, reaches)]
            names = [n for n in batch.schema.names if n != "_centres"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + lists, names=[*names, "_slot", "_reach"])

    return run


def metric_tree(rows: DataFrame, keys: Sequence[str], *, most: int, fan: int = 32, block: int = 1024, metric: str = "euclidean", p: float = 2.0):
    """Place ``rows`` (keys, _id, _copy, _v, _first, _counts) into groups of at most ``most`` rows that count.

    ``_counts`` marks rows that count for sizes, ``_first`` one row a distinct vector among them (from which
    centres are drawn, so a split always separates something). Returns the rows with _node (the path; empty at the
    root) and _reach (distance to the node's centre, null at the root), and the nodes (keys, _node, _parent, _centre,
    _radius, _n rows that count, _leaf), or None where nothing had to be split. ``most`` must be at least the counting copies of one vector."""
    from ..session import cut_lineage

    keys = list(keys)
    payload = ["_id", "_copy", "_v", "_first", "_counts"]
    placed = rows.select(*keys, *payload, F.lit("").alias("_node"), F.lit(None).cast("double").alias("_reach"))
    levels: list[DataFrame] = []
    done: list[DataFrame] = []
    while True:
        sizes = placed.groupBy(*keys, "_node").agg(F.sum(F.col("_counts").cast("long")).alias("_n"))
        large = sizes.where(F.col("_n") > most)
        if large.isEmpty():
            done.append(placed)
            break
        if not levels:
            placed = cut_lineage(placed)
            large = placed.groupBy(*keys, "_node").agg(F.sum(F.col("_counts").cast("long")).alias("_n")).where(F.col("_n") > most)
        done.append(placed.join(large, [*keys, "_node"], "left_anti"))
        split = placed.join(large, [*keys, "_node"], "left_semi")
        drawn = Window.partitionBy(*keys, "_node").orderBy(F.xxhash64("_v", F.lit(len(levels))), "_v")
        centres = split.where("_first").select(*keys, "_node", "_v", F.row_number().over(drawn).alias("_rank")).where(F.col("_rank") <= fan)
        enough = F.greatest(F.lit(2), F.ceil(2 * F.col("_n") / F.lit(most)))  # cells come out about half full
        centres = centres.join(large, [*keys, "_node"]).where(F.col("_rank") <= enough).groupBy(*keys, "_node").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_v"))), lambda s: s["_v"]).alias("_centres"))
        centres = cut_lineage(centres)
        blocks = in_blocks(split, [*keys, "_node"], block, payload).join(centres, [*keys, "_node"]).select(*keys, "_node", *payload, "_centres")
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name != "_centres")
        found = blocks.mapInArrow(_nearest(metric, p), f"{ddl}, _slot array<int>, _reach array<double>")
        zipped = F.inline(F.arrays_zip(*[F.col(c) for c in (*payload, "_slot", "_reach")]))
        placed = found.select(*keys, F.col("_node").alias("_above"), zipped)
        placed = cut_lineage(placed.select(*keys, *payload, F.concat_ws(".", "_above", F.col("_slot").cast("string")).alias("_node"), "_reach"))
        slots = centres.select(*keys, F.col("_node").alias("_parent"), F.posexplode("_centres").alias("_slot", "_centre"))
        slots = slots.select(*keys, "_parent", F.concat_ws(".", "_parent", F.col("_slot").cast("string")).alias("_node"), "_centre")
        radii = placed.where("_counts").groupBy(*keys, "_node").agg(F.max("_reach").alias("_radius"), F.count(F.lit(1)).alias("_n"))
        levels.append(slots.join(radii, [*keys, "_node"]))
    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    if not levels:
        return everything, None
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    inner = nodes.select(*keys, F.col("_parent").alias("_node")).distinct().withColumn("_leaf", F.lit(False))
    nodes = nodes.join(inner, [*keys, "_node"], "left").withColumn("_leaf", F.coalesce("_leaf", F.lit(True)))
    return everything, cut_lineage(nodes)


def depth(nodes: DataFrame) -> int:
    return nodes.agg(F.max(F.size(F.split("_node", r"\.")))).first()[0]


def sibling_bound(nodes: DataFrame, heads: DataFrame, keys: Sequence[str], k: int, metric: str, p: float) -> DataFrame:
    """``heads`` with _tau no larger than the farthest point of any sibling that holds more than ``k`` rows that count.

    Cells of a few rows find too few neighbours at home to have a bound of their own."""
    keys = list(keys)
    beside = nodes.where(F.col("_n") > k).select(*keys, "_parent", F.col("_centre").alias("_c"), F.col("_radius").alias("_far"))
    own = heads.join(nodes.select(*keys, "_node", "_parent"), [*keys, "_node"]).select(*keys, "_head", "_parent", "_centre", "_reach")
    end = distance(F.col("_centre"), F.col("_c"), metric, p) + F.col("_reach") + F.col("_far")
    ends = own.join(beside, [*keys, "_parent"]).groupBy(*keys, "_head").agg((F.min(end) * (1 + SLACK)).alias("_end"))
    return heads.join(ends, [*keys, "_head"], "left").withColumn("_tau", F.least("_tau", F.coalesce("_end", "_tau"))).drop("_end")


def within_bound(nodes: DataFrame, heads: DataFrame, keys: Sequence[str], metric: str, p: float) -> DataFrame:
    """Pairs (keys, _head, _node of a leaf) that the triangle inequality cannot rule out.

    ``heads`` are groups of queries: keys, _head (their name), _centre, _reach (largest distance of a query to the
    centre) and _tau (a distance that no query has to look beyond). They go down the tree level by level: a join with
    the children of the nodes that they have reached."""
    keys = list(keys)
    heads = heads.select(*keys, "_head", F.col("_centre").alias("_c"), F.col("_reach").alias("_r"), F.col("_tau").alias("_t"))
    away = distance(F.col("_c"), F.col("_centre"), metric, p)
    slack = SLACK * (1 + away + F.col("_r") + F.col("_radius"))
    near = away - F.col("_r") - F.col("_radius") - slack <= F.col("_t")
    kept = [*keys, "_head", "_c", "_r", "_t", "_node", "_leaf"]
    front = heads.join(nodes.where(F.col("_parent") == ""), keys).where(near).select(*kept)
    found = front.where("_leaf")
    for _ in range(1, depth(nodes)):
        front = front.where(~F.col("_leaf")).withColumnRenamed("_node", "_parent").drop("_leaf")
        front = front.join(nodes, [*keys, "_parent"]).where(near).select(*kept)
        found = found.unionByName(front.where("_leaf"))
    return found.select(*keys, "_head", "_node")
