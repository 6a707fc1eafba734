"""Near duplicates by min-max hashing.

A document's set holds its distinct shingles of five words (as 64-bit hashes).
Each random permutation gives two signature values, the least and the greatest
hash under it, so 120 permutations make 240 values of lower variance than 240
minima. Bands of five values propose documents whose sets may be alike; every
link is then confirmed on the full sets.

What is done so that no group is ever expanded into pairs:

1. Documents with equal sets are one class from the start; only its smallest id
   goes on.
2. Documents that share a band meet in a bucket. Each is linked to the smallest id
   that it shares a bucket with, where the sets are alike. Links are joined to
   components.
3. Buckets that are one component now, which is what groups of copies become, are
   done. In the others, signatures of different components are compared, in blocks
   of bounded size. Documents with a likely partner there come together once more
   with their sets, and the likeliest pairs are confirmed first; a pair that other
   links have joined meanwhile needs no look. Only confirmed links leave a block,
   and a pair that shares several buckets comes up in one.

Two sets at the threshold share no band, or differ so much by signature, with a
probability under one in a hundred thousand.

Null, empty and blank texts have empty sets and link with nothing. Rows with
null ids are not linked: their component is null and they are kept. Rows with
equal ids get one component; where their texts differ, each text counts. Columns
other than id and text are not read, so their names cannot clash. An empty table
gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, id_text, remembers, rows, written

PERMUTATIONS = 120
BAND = 5  # values of a band
_RANDOM = np.random.default_rng(97)
TIMES = _RANDOM.integers(0, 1 << 31, size=PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PLUS = _RANDOM.integers(0, 1 << 32, size=PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
STEP = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: share of equal signature values from which a pair is confirmed; 4.4 standard deviations below a similarity of 0.75
LIKELY = 0.625
BLOCK = 2048
#: words whose hashes are remembered: their number, and the bytes of each at most
REMEMBERED, REMEMBERED_BYTES = 250_000, 64


class _Words(dict):
    """Hashes of words; remembers a bounded number of short ones."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The document's set, sorted."""
    words = (text or "").encode().lower().split()  # of bytes, lower() changes A to Z only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.array(list(map(_WORDS.__getitem__, words)), dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(STEP) + h[k : len(h) - n + 1 + k]
    return np.unique(_mixed(out))


def signature(own: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, side by side."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    least, most = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32), np.zeros(PERMUTATIONS, dtype=np.uint32)
    for lo in range(0, len(x), 2048):
        seen = x[lo : lo + 2048, None] * TIMES + PLUS
        np.minimum(least, seen.min(axis=0), out=least)
        np.maximum(most, seen.max(axis=0), out=most)
    return np.stack([least, most], axis=1).ravel()


def bands(values: np.ndarray) -> np.ndarray:
    parts = values.astype(np.uint64).reshape(-1, BAND)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(BAND):
        key = _mixed(key * MIX + parts[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (null: empty set), its band keys, and one byte of each signature value."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("brief", pa.binary())])

    def run(batches):
        def out():
            for d, t in rows(batches, "doc_id", "text"):
                own = shingles(t)
                if len(own):
                    values = signature(own)
                    yield d, len(own), xxhash.xxh3_128_digest(own.tobytes()), bands(values), (values * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()
                else:
                    yield d, 0, None, None, None

        remembers("minhash", _WORDS.clear)
        yield from batched(out(), schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, brief binary")


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and set of the documents in ``ids``."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.list_(pa.int64()))])

    def run(batches):
        remembers("minhash", _WORDS.clear)
        yield from batched(((d, shingles(t).view(np.int64)) for d, t in rows(batches, "doc_id", "text")), schema, size=128)

    return id_text(docs, id_col, text_col).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, own array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    left = sets.join(pairs, sets["doc_id"] == pairs["a"]).select("a", "b", F.col("own").alias("own_a"))
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("own_b")), "b")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return both.filter(100 * shared >= percent * (F.size("own_a") + F.size("own_b") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """doc_id and the smallest id it is connected to, for every id in ``links`` (a, b).

    Large-star and small-star steps, each a grouped minimum and a join, until every
    id points at the smallest of its component."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").filter("u <> v").distinct(), "links")
        # done when everything points straight at something that points nowhere
        twice = edges.groupBy("u").count().filter("count > 1")
        deeper = edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        if twice.isEmpty() and deeper.isEmpty():
            break
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _likely(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, share of equal signature values) of pairs of different components in one bucket, or two blocks of one."""
    part, band = table.column("part")[0].as_py(), table.column("band")[0].as_py()
    comp, block = table.column("component").to_numpy(), table.column("block").to_numpy()
    brief = np.frombuffer(b"".join(table.column("brief").to_pylist()), dtype=np.uint8).reshape(len(comp), -1)
    keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(comp), -1)
    left, right = np.flatnonzero(block == part["i"]), np.flatnonzero(block == part["j"])
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    names, sizes = np.unique(comp, return_counts=True)
    main = names[sizes.argmax()]
    # every pair of different components has a member outside the largest one
    for x, others in ((left, right),) if part["i"] == part["j"] else ((left, right), (right, left)):
        for i in x[comp[x] != main].tolist():
            same = brief[others] == brief[i]
            near = np.flatnonzero((comp[others] != comp[i]) & (same.mean(axis=1) >= LIKELY))
            met = keys[others[near]] == keys[i]  # the full keys, which buckets are made of: this one is among them
            here = met.argmax(axis=1) == band  # the first band that they share
            found.append((np.full(int(here.sum()), i), others[near[here]], same[near[here]].mean(axis=1)))
    return tuple(np.concatenate(f) for f in zip(*found))


def _involved(table: pa.Table) -> pa.Table:
    """The rows that are in a likely pair."""
    a, b, _ = _likely(table)
    return table.take(pa.array(np.unique(np.concatenate([a, b]))))


def _links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Confirmed links, the likeliest pairs first, none within what is linked already."""
        ids, comp = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        lists = table.column("own").combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        parent = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        a, b, likeness = _likely(table)
        out: tuple[list[int], list[int]] = ([], [])
        for n in np.argsort(-likeness, kind="stable").tolist():
            i, j = int(a[n]), int(b[n])
            ci, cj = top(int(comp[i])), top(int(comp[j]))
            if ci == cj:
                continue
            x, y = flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                parent[max(ci, cj)] = min(ci, cj)
                out[0].append(max(ids[i], ids[j]))
                out[1].append(min(ids[i], ids[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def linked(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and whether it is kept (the smallest id of its component)."""
    signed = written(signatures(docs, id_col, text_col), "signed")
    usable = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes, (usable["digest"] == classes["digest"]) & (usable["doc_id"] == classes["rep"]), "left_semi")
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = written(banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    buckets = written(banded.join(shared, "key"), "buckets")  # key, doc_id, band, hub, n

    stars = buckets.filter("doc_id <> hub").groupBy(F.col("doc_id").alias("a")).agg(F.min("hub").alias("b"))
    sets = written(sets_of(docs, buckets.select("doc_id").distinct(), id_col, text_col), "sets")
    # texts that share an id are one document, so their classes are linked through it
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1").select("doc_id")
    same_id = usable.join(several, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = written(confirmed(stars, sets, percent).union(same_id), "first")
    found = written(components(links), "found")

    def labelled(rows: DataFrame, column: str, name: str) -> DataFrame:
        joined = rows.join(found.select(F.col("doc_id").alias("_id"), F.col("component").alias("_c")), F.col(column) == F.col("_id"), "left")
        return joined.withColumn(name, F.coalesce("_c", column)).drop("_id", "_c")

    placed = written(labelled(buckets.select("key", "band", "doc_id", "n"), "doc_id", "component"), "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = placed.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    pair_up = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    rest = rest.select("key", "band", "doc_id", "component", "block", F.explode(pair_up).alias("part"))
    rest = rest.join(reps.select("doc_id", "bands", "brief"), "doc_id").select("key", "band", "part", "doc_id", "component", "block", "bands", "brief")
    likely = written(rest.groupBy("key", "part").applyInArrow(_involved, rest.schema), "likely")
    with_sets = likely.join(sets, "doc_id").select(*likely.columns, "own")
    more = written(with_sets.groupBy("key", "part").applyInArrow(_links(percent), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        found = written(components(links.union(more)), "found")

    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    rows = rows.join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    result = labelled(rows, "rep", "component_id")
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return result.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_copies(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    gone = linked(docs, percent, id_col, text_col).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
