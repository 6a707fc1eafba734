"""Exact k-nearest neighbours within cohorts (M14, J6, W2, T-6), without all pairs.

1. Of rows with one and the same vector only the first k + 1 (by id) can be among
   anyone's k nearest, since ties go by id; the others only ask (``_counts``).
2. A cohort with more rows than ``candidate_block`` is split into metric cells
   (:mod:`.cells`): bounded groups with a centre and a radius.
3. Every block of queries is searched in its own cell first; the k-th distance found
   there is a bound for each row.
4. Blocks go down the tree of cells and ask only for the cells that the triangle
   inequality cannot rule out at that bound. Neighbouring blocks are put into groups,
   and a task gets the rows of a group once and then, one after the other, a share of
   the cells that any of its blocks asked for; it keeps the k nearest so far of every
   row, so bounds shrink from cell to cell and only k neighbours a row leave the task.
   Rows whose own bound rules a cell out are left aside before any distance is taken.
5. NumPy works on flat Arrow buffers, in tiles that fit in the processor's cache: rough
   distances (inner products, single precision or 16-bit steps) with a bound on their
   error rule out nearly all pairs, the rest get exact ones (:func:`nearest`). A
   ``row_number() <= k`` window merges the partial lists (``WindowGroupLimit``).

No row pairs are materialised and no side is broadcast by hint. On clustered data a
block meets a few cells; where distances tell nothing apart (high dimensions without
structure) it meets all of them, as any exact search must. Self-exclusion is by row;
ties are ordered by neighbour id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import SLACK, Balls, Boxes, Rough, Whole, each_row, in_blocks, matrix, metric_tree, of_pairs, pairwise, sibling_bound, within_bound

METRICS = ("minkowski", "euclidean", "manhattan", "chebyshev")
#: distances are taken for so many rows and candidates at a time: inner products, and sums over dimensions
TILE, TILE_SUMS = (512, 1024), (16, 4096)
#: so many rows look into their boxes at a time, and get a first bound from so many candidates
TILE_BOXES, TILE_REACH = 256, (32, 2048)
#: so many queries ask together for cells, and their cells are dealt over so many tasks
GROUP, PARTS = 65536, 8


def top_k_per_row(dist: np.ndarray, cand_ids: np.ndarray, k: int):
    """Vectorised exact top-k of every row of a distance matrix, ties ordered by
    candidate id; infinite distances (self) are never returned.
    Returns (row index, column index, distance) arrays sorted by row then rank."""
    nq, nc = dist.shape
    take = min(k, nc)
    if take < nc:
        kth = np.partition(dist, take - 1, axis=1)[:, take - 1]
    else:
        kth = np.full(nq, np.inf)
    mask = (dist <= kth[:, None]) & np.isfinite(dist)  # keeps every candidate tied with the k-th
    r, c = np.nonzero(mask)
    return _first(r, c, dist[r, c], cand_ids, take)


def _first(r: np.ndarray, c: np.ndarray, d: np.ndarray, cand_ids: np.ndarray, take: int):
    """The first ``take`` pairs of every row."""
    order = np.lexsort((cand_ids[c], d, r))
    r, c, d = r[order], c[order], d[order]
    if len(r) == 0:
        return r, c, d
    starts = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
    lengths = np.diff(np.r_[starts, len(r)])
    rank = np.arange(len(r)) - np.repeat(starts, lengths)
    keep = rank < take
    return r[keep], c[keep], d[keep]


def nearest(q: np.ndarray, c: np.ndarray, cand_ids: np.ndarray, k: int, metric: str, p: float, itself=None, tau: np.ndarray | None = None):
    """Exact top k of every row of ``q`` among ``c`` (those within ``tau``, where given), as :func:`top_k_per_row` has them.

    ``itself(s, e)`` says which candidates are the rows s..e themselves (none, where it is not given). Rough distances rule
    out nearly all pairs; only what they leave gets an exact distance. Candidates are met a tile at a time, and the k nearest
    so far bound what the next tile has to show."""
    if metric == "chebyshev" and Boxes.fits(q, c) and np.isfinite(q).all() and np.isfinite(c).all():
        reach = _first_reach(q, c, k, itself) if tau is None else tau
        if np.isfinite(reach).all():
            return _in_boxes(q, c, cand_ids, k, reach, itself)
    if metric == "minkowski" and tau is not None and np.isfinite(tau).all() and Balls.fits(q, c, p):
        return _in_balls(q, c, cand_ids, k, p, tau, itself)
    rough, found = Rough(c, metric, p), []
    fast = rough.usable(q) and len(c) > 0
    tall, wide = (TILE if rough.euclid else TILE_SUMS) if fast else (max(1, (1 << 18) // max(1, len(c))), max(1, len(c)))
    summed = fast and (metric == "chebyshev" or rough.order == 1) and Whole.fits(q, c)
    whole = Whole(q, c, metric) if summed else None
    for s in range(0, len(q), tall):
        part, self_ = q[s:s + tall], None if itself is None else itself(s, s + tall)
        bound = np.full(len(part), np.inf) if tau is None else np.array(tau[s:s + tall], dtype=float)
        best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for t in range(0, len(c), wide):
            some = slice(t, t + wide)
            width = min(wide, len(c) - t)
            if whole is not None and whole.error < 0.1 * bound.min() and np.isfinite(bound).all():
                at = whole.within(slice(s, s + tall), some, bound)
            else:
                if fast:
                    about, error = rough.to(part, some)
                else:
                    about, error = pairwise(part, c, metric, p), 0.0
                if self_ is not None:
                    about[self_[:, some]] = np.inf
                open_ = np.flatnonzero(~np.isfinite(bound))
                if len(open_) and k <= width:
                    kth = np.partition(about[open_], k - 1, axis=1)[:, k - 1]
                    bound[open_] = rough.reach(kth, error) if fast else kth
                if fast:  # rounded up, so single precision loses none
                    limit = np.nextafter(rough.limit(bound, error).astype(np.float32), np.float32(np.inf))
                else:
                    limit = bound * (1 + SLACK)
                at = np.flatnonzero((about <= limit[:, None]) & np.isfinite(about))
            i, j = np.divmod(at, width)
            j += t
            if self_ is not None:
                other = ~self_[i, j]
                i, j = i[other], j[other]
            d = of_pairs(part[i], c[j], metric, p)
            within = d <= bound[i] if tau is not None else np.isfinite(d)
            best = tuple(np.concatenate([x, y[within]]) for x, y in zip(best, (i, j, d)))
            if tau is None and t + wide < len(c):
                best = _first(*best, cand_ids, k)
                n = np.bincount(best[0], minlength=len(part))
                last = np.cumsum(n)[n == k] - 1
                bound[n == k] = np.minimum(bound[n == k], best[2][last])
        i, j, d = _first(*best, cand_ids, k)
        found.append((i + s, j, d))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _first_reach(q: np.ndarray, c: np.ndarray, k: int, itself) -> np.ndarray:
    """For every row a Chebyshev distance within which the first candidates hold ``k`` others (infinite where they do not)."""
    tall, wide = TILE_REACH
    rough, out = Rough(c[:wide], "chebyshev", np.inf), np.full(len(q), np.inf)
    if not rough.usable(q) or k > len(rough.c[0]):
        return out
    for s in range(0, len(q), tall):
        about, error = rough.to(q[s:s + tall])
        if itself is not None:
            about[itself(s, s + tall)[:, :wide]] = np.inf
        out[s:s + tall] = rough.reach(np.partition(about, k - 1, axis=1)[:, k - 1], error)
    return out


def _in_boxes(q: np.ndarray, c: np.ndarray, cand_ids: np.ndarray, k: int, tau: np.ndarray, itself=None):
    """:func:`nearest` by Chebyshev distance within ``tau``: only candidates in the box of a row get a distance."""
    boxes, found = Boxes(c), []
    for s in range(0, len(q), TILE_BOXES):
        part, bound = q[s:s + TILE_BOXES], tau[s:s + TILE_BOXES]
        i, j = boxes.within(part, bound)
        if itself is not None:
            other = ~itself(s, s + TILE_BOXES)[i, j]
            i, j = i[other], j[other]
        d = of_pairs(part[i], c[j], "chebyshev", np.inf)
        within = d <= bound[i]
        i, j, d = _first(i[within], j[within], d[within], cand_ids, k)
        found.append((i + s, j, d))
    return tuple(np.concatenate(x) for x in zip(*found))


def _in_balls(q: np.ndarray, c: np.ndarray, cand_ids: np.ndarray, k: int, p: float, tau: np.ndarray, itself=None):
    """:func:`nearest` by Minkowski distance within ``tau``: only pairs that their Euclidean distance leaves open get another."""
    balls, found, (tall, wide) = Balls(q, c, p), [], TILE
    for s in range(0, len(q), tall):
        rows = slice(s, s + tall)
        part, bound = q[rows], np.array(tau[rows], dtype=float)
        self_ = None if itself is None else itself(s, s + tall)
        best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for t in range(0, len(c), wide):
            i, j = balls.within(rows, slice(t, t + wide), bound)
            j += t
            if self_ is not None:
                other = ~self_[i, j]
                i, j = i[other], j[other]
            d = of_pairs(part[i], c[j], "minkowski", p)
            within = d <= bound[i]
            if not within.any():
                continue
            best = _first(*(np.concatenate([x, y[within]]) for x, y in zip(best, (i, j, d))), cand_ids, k)
            n = np.bincount(best[0], minlength=len(part))
            full = n == k
            bound[full] = np.minimum(bound[full], best[2][np.cumsum(n)[full] - 1])
        found.append((best[0] + s, *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(k: int, metric: str, p: float, names: Sequence[str], schema: pa.Schema):
    """Top k of each query block (_id, _copy, _v) in its own cell (c_id, c_copy, c_v)."""

    def run(batches):
        for r in each_row(batches):
            ids, copies, q = r["_id"].values, np.asarray(r["_copy"].values), matrix(r["_v"].values)
            c_ids, c_copies, c = r["c_id"].values, np.asarray(r["c_copy"].values), matrix(r["c_v"].values)
            if not len(q) or not len(c):
                continue
            mine, theirs = ids.to_numpy(zero_copy_only=False), c_ids.to_numpy(zero_copy_only=False)

            def itself(s, e, mine=mine, copies=copies, theirs=theirs, c_copies=c_copies):
                return (mine[s:e, None] == theirs[None, :]) & (copies[s:e, None] == c_copies[None, :])

            i, j, found = nearest(q, c, theirs, k, metric, p, itself)
            if len(i):
                cols = [pa.repeat(r[n], len(i)) for n in names]
                cols += [ids.take(pa.array(i)), pa.array(copies[i]), c_ids.take(pa.array(j)), pa.array(c_copies[j]), pa.array(found)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema)], schema=schema)

    return run


class _Asking:
    """The queries of a group, and the k nearest of each in the cells met so far."""

    def __init__(self, k: int, metric: str, p: float):
        self.k, self.metric, self.p = k, metric, p
        self.blocks: list[tuple] = []
        self.rows = None

    def ask(self, r: dict) -> None:
        n = len(r["_id"].values)
        self.blocks.append((r["_id"].values, np.asarray(r["_copy"].values), matrix(r["_v"].values), np.asarray(r["_tau"].values), [r["_node"].as_py()] * n))

    def meet(self, r: dict) -> None:
        """Search one cell (its rows are in _id, _copy, _v)."""
        if self.rows is None:
            ids, copies, vectors, tau, home = zip(*self.blocks)
            self.rows = pa.concat_arrays(ids), np.concatenate(copies), np.concatenate(vectors), np.array(sum(home, []))
            self.tau = np.concatenate(tau)
            self.best = [(np.zeros(0, int), None, np.zeros(0, int), np.zeros(0))]
        _, _, q, home = self.rows
        ids, copies, c = r["_id"].values, np.asarray(r["_copy"].values), matrix(r["_v"].values)
        if not len(c):
            return
        radius = r["_radius"].as_py()
        away = pairwise(q, matrix(pa.array([r["_centre"].as_py()])), self.metric, self.p)[:, 0]
        at = np.flatnonzero((away - radius - SLACK * (1 + away + radius) <= self.tau) & (home != r["_node"].as_py()))
        if not len(at):
            return
        names = ids.to_numpy(zero_copy_only=False)
        i, j, d = nearest(q[at], c, names, self.k, self.metric, self.p, None, self.tau[at])
        if len(i):
            self.best.append((at[i], ids.take(pa.array(j)), copies[j], d))
            if sum(len(x[0]) for x in self.best[1:]) > len(self.best[0][0]) // 2 + 4 * len(q):
                self.settle()

    def settle(self) -> None:
        """Keep the k nearest of every row, which bound what is still looked for."""
        held = [x for x in self.best if x[1] is not None]
        if not held:
            return
        rows, copies, d = (np.concatenate([x[n] for x in held]) for n in (0, 2, 3))
        ids = pa.concat_arrays([x[1] for x in held])
        i, j, d = _first(rows, np.arange(len(rows)), d, ids.to_numpy(zero_copy_only=False), self.k)
        self.best = [(i, ids.take(pa.array(j)), copies[j], d)]
        n = np.bincount(i, minlength=len(self.tau))
        full = n == self.k
        self.tau[full] = np.minimum(self.tau[full], d[np.cumsum(n)[full] - 1])

    def found(self, key: Sequence[pa.Scalar], schema: pa.Schema, at_once: int = 1 << 16) -> list[pa.RecordBatch]:
        if self.rows is None:
            return []
        self.settle()
        i, c_ids, c_copies, d = self.best[0]
        if not len(i):
            return []
        ids, copies, _, _ = self.rows
        cols = [pa.repeat(x, len(i)) for x in key] + [ids.take(pa.array(i)), pa.array(copies[i]), c_ids, pa.array(c_copies), pa.array(d)]
        out = pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema)], schema=schema)
        return [out.slice(s, at_once) for s in range(0, len(i), at_once)]


def _search_cells(k: int, metric: str, p: float, names: Sequence[str], schema: pa.Schema):
    """Top k of the queries of each group in a share of the cells that they asked for; a group's queries come before its cells."""

    def run(batches):
        at, key, asking = None, (), None
        for r in each_row(batches):
            here = tuple(r[n].as_py() for n in (*names, "_group", "_part"))
            if here != at or asking is None:
                if asking is not None:
                    yield from asking.found(key, schema)
                at, key, asking = here, [r[n] for n in names], _Asking(k, metric, p)
            if r["_kind"].as_py() == 0:
                asking.ask(r)
            else:
                asking.meet(r)
        if asking is not None:
            yield from asking.found(key, schema)

    return run


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def cell_pairs(own: DataFrame, queries: DataFrame, nodes: DataFrame, ck: Sequence[str], k: int, metric: str, p: float, query_block: int):
    """Query blocks with their bounds, and the (block, cell) pairs beyond the own cell that have to be searched."""
    from ..session import cut_lineage

    least = F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf")))
    tau = own.groupBy(*ck, "_id", "_copy").agg(least.alias("_tau"))
    bounded = queries.join(tau, [*ck, "_id", "_copy"], "left").withColumn("_tau", F.coalesce("_tau", F.lit(float("inf"))))
    blocks = in_blocks(bounded.where(F.col("_node") != ""), [*ck, "_node"], query_block, ["_id", "_copy", "_v", "_tau"],
                       F.max("_reach").alias("_r"), F.max("_tau").alias("_t"))
    blocks = cut_lineage(blocks.withColumn("_head", F.struct(F.col("_node").alias("node"), F.col("_qb").alias("qb"))))
    heads = blocks.select(*ck, "_node", "_head", F.col("_r").alias("_reach"), F.col("_t").alias("_tau"))
    heads = heads.join(nodes.select(*ck, "_node", "_centre"), [*ck, "_node"])
    heads = sibling_bound(nodes, heads, ck, k, metric, p)
    pairs = within_bound(nodes, heads, ck, metric, p).where(F.col("_head.node") != F.col("_node"))
    return blocks, cut_lineage(pairs)


def _beyond(blocks: DataFrame, pairs: DataFrame, cells: DataFrame, nodes: DataFrame, ck: Sequence[str]) -> DataFrame:
    """Groups of neighbouring blocks that ask for cells, and behind them the cells: each group meets every cell that one of its
    blocks asked for, in one of ``PARTS`` shares (_group, _part). Sorted so that a share's queries (_kind 0) come first."""
    ck = list(ck)
    share = [*ck, "_group", "_part"]
    heads = blocks.select(*ck, "_head", "_node", "_qb", F.size("_id").alias("_n"))  # a row a block
    heads = heads.join(pairs.select(*ck, "_head").distinct(), [*ck, "_head"], "left_semi")
    upto = F.sum("_n").over(Window.partitionBy(*ck).orderBy("_node", "_qb").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    groups = heads.select(*ck, "_head", F.floor((upto - 1) / F.lit(GROUP)).alias("_group"))
    asked = pairs.join(groups, [*ck, "_head"]).select(*ck, "_group", "_node").distinct()
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_node"), F.lit(PARTS)).cast("int"))
    shares = groups.join(asked.select(*share).distinct(), [*ck, "_group"])
    queries = blocks.join(shares, [*ck, "_head"]).select(
        *share, F.lit(0).alias("_kind"), "_node", "_id", "_copy", "_v", "_tau", F.lit(None).cast("array<double>").alias("_centre"), F.lit(None).cast("double").alias("_radius"))
    met = cells.join(asked, [*ck, "_node"]).join(nodes.select(*ck, "_node", "_centre", "_radius"), [*ck, "_node"]).select(
        *share, F.lit(1).alias("_kind"), "_node", F.col("c_id").alias("_id"), F.col("c_copy").alias("_copy"), F.col("c_v").alias("_v"),
        F.lit(None).cast("array<double>").alias("_tau"), "_centre", "_radius")
    return queries.unionByName(met).repartition(*share).sortWithinPartitions(*share, "_kind")


def knn(
    df: DataFrame,
    *,
    id_col: str,
    vec_col: str,
    k: int,
    metric: str = "minkowski",
    p: float = 2.0,
    cohort: Sequence[str] = (),
    query_block: int = 4096,
    candidate_block: int = 16384,
    fan: int = 32,
    only_ids: Sequence | None = None,
) -> DataFrame:
    """(cohort..., id, neighbor_rank, neighbor_id, distance) with k_eff = min(k, n-1) rows per id.

    ``only_ids`` searches for these ids alone, among all rows. Cells hold at most
    ``candidate_block`` rows that can be neighbours (k + 1 at least)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if metric == "minkowski" and p < 1:
        raise ValueError("minkowski p must be >= 1")
    kk, pp = int(k), float(p)
    names = list(cohort)
    ck = names or ["_all"]
    df = df if names else df.withColumn("_all", F.lit(0))
    vector = F.col(vec_col).cast("array<double>")
    # rows that share an id are told apart by a number, so only the row itself is left out
    copies = Window.partitionBy(*ck, id_col).orderBy(vector)
    base = df.select(*ck, F.col(id_col).alias("_id"), F.row_number().over(copies).alias("_copy"), vector.alias("_v"))
    same = F.row_number().over(Window.partitionBy(*ck, "_v").orderBy("_id", "_copy"))
    base = base.withColumn("_rank", same).withColumn("_counts", F.col("_rank") <= kk + 1).withColumn("_first", F.col("_rank") == 1).drop("_rank")
    placed, nodes = metric_tree(base, ck, most=max(candidate_block, kk + 1), fan=fan, block=query_block, metric=metric, p=pp)

    queries = placed if only_ids is None else placed.where(F.col("_id").isin(*only_ids))
    cells = placed.where("_counts").groupBy(*ck, "_node").agg(F.collect_list(F.struct("_id", "_copy", "_v")).alias("_c"))
    cells = cells.select(*ck, "_node", F.col("_c._id").alias("c_id"), F.col("_c._copy").alias("c_copy"), F.col("_c._v").alias("c_v"))
    blocks = in_blocks(queries, [*ck, "_node"], query_block, ["_id", "_copy", "_v"])
    asked = blocks.select(*ck, "_node", "_bq").distinct()
    dealt = cells.join(asked, [*ck, "_node"]).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_bq") - 1))).drop("_bq")
    at_home = blocks.drop("_bq").join(dealt, [*ck, "_node", "_qb"])
    shape = base.select(*ck, "_id", "_copy", F.col("_id").alias("neighbor_id"), F.col("_copy").alias("_ncopy"), F.lit(0.0).alias("distance"))
    schema = _arrow_schema(shape)
    partial = at_home.mapInArrow(_search(kk, metric, pp, ck, schema), shape.schema)
    if nodes is not None:
        from ..session import cut_lineage

        partial = cut_lineage(partial)
        held, pairs = cell_pairs(partial, queries, nodes, ck, kk, metric, pp, query_block)
        partial = partial.unionByName(_beyond(held, pairs, cells, nodes, ck).mapInArrow(_search_cells(kk, metric, pp, ck, schema), shape.schema))
    w = Window.partitionBy(*ck, "_id", "_copy").orderBy("distance", "neighbor_id", "_ncopy")
    return (
        partial.withColumn("neighbor_rank", F.row_number().over(w))
        .where(F.col("neighbor_rank") <= kk)
        .select(*names, F.col("_id").alias(id_col), "neighbor_rank", "neighbor_id", "distance")
    )


def neighbor_table(
    df: DataFrame,
    *,
    vec_col: str,
    k: int,
    metric: str = "minkowski",
    p: float = 2.0,
    cohort: Sequence[str] = ("role", "year"),
    id_col: str = "player_id",
    name_col: str | None = "player_name",
) -> DataFrame:
    """M14 output shape: player_id, [player_name], year, role, neighbor_rank,
    neighbor_player_id, [neighbor_player_name], distance."""
    nn = knn(df, id_col=id_col, vec_col=vec_col, k=k, metric=metric, p=p, cohort=cohort)
    nn = nn.withColumnRenamed("neighbor_id", f"neighbor_{id_col}")
    if name_col and name_col in df.columns:
        names = df.select(*cohort, id_col, name_col)
        nn = nn.join(names, [*cohort, id_col], "left")
        nb = names.withColumnRenamed(id_col, f"neighbor_{id_col}").withColumnRenamed(name_col, f"neighbor_{name_col}")
        nn = nn.join(nb, [*cohort, f"neighbor_{id_col}"], "left")
        cols = [id_col, name_col, *cohort, "neighbor_rank", f"neighbor_{id_col}", f"neighbor_{name_col}", "distance"]
    else:
        cols = [id_col, *cohort, "neighbor_rank", f"neighbor_{id_col}", "distance"]
    return nn.select(*cols)


def effective_k(k: int, n: int) -> int:
    return max(0, min(int(k), int(n) - 1))
