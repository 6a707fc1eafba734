"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

A paragraph is a line of the text and hashes to the SHA-256 of its bytes. A
section is a run of paragraphs; it ends after a blank paragraph or one whose
hash begins with a hexadecimal digit below 4, so an edit moves no section
border but its own. A section hashes its paragraphs' hashes, the root hashes the
sections' hashes and is the document's fingerprint. Equal roots mean equal
texts; where roots differ, differing sections and, below them, differing
paragraphs show where the edit is.

Below a paragraph, phrases (words up to one with a closing mark or a given last
letter) are hashed too. The likeness of two texts is 1 where the roots are equal,
otherwise the Dice coefficient of their sets of phrase hashes.

Null texts are empty; the empty text has one empty paragraph. In
:func:`with_next`, rows follow falling id (a null id counts as the least), equal ids
a hash of their text, and the row after the last is the first; repeated rows come once each.
Columns other than id and text are not read, so their names cannot clash. An empty
table gives an empty result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text

#: where a phrase ends
PHRASE_END = r"\n|(?<=[.,;:!?dglnz])[ \t]+"
SECTION_END = "0123"
#: what a null id counts as
LEAST = -(2**63)
MAX_RANGES = 1 << 16


def paragraph_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))


def section_hashes(paragraphs: Column) -> Column:
    """Hashes of the runs of paragraphs."""
    blank = F.sha2(F.lit(""), 256)
    marked = F.transform(paragraphs, lambda h: F.when(F.substring(h, 1, 1).isin(*SECTION_END) | (h == blank), F.concat(h, F.lit("|"))).otherwise(h))
    runs = F.split(F.regexp_replace(F.array_join(marked, ""), r"\|$", ""), r"\|")
    return F.transform(runs, lambda r: F.sha2(r, 256))


def root_hash(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def tree(text: Column) -> Column:
    """Struct of root, sections and paragraphs (hexadecimal)."""
    paragraphs = paragraph_hashes(text)
    sections = section_hashes(paragraphs)
    return F.struct(root_hash(sections).alias("root"), sections.alias("sections"), paragraphs.alias("paragraphs"))


def phrases(text: Column) -> Column:
    """Distinct phrase hashes."""
    return F.array_distinct(F.transform(F.split(text, PHRASE_END), lambda x: F.xxhash64(x)))


def likeness(root_a: Column, phrases_a: Column, root_b: Column, phrases_b: Column) -> Column:
    shared = F.size(F.array_intersect(phrases_a, phrases_b))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(2.0 * shared / (F.size(phrases_a) + F.size(phrases_b)))


def changed(tree_a: Column, tree_b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``tree_a`` that ``tree_b`` has nowhere. Equal roots settle it at once."""
    numbered = F.transform(tree_a["paragraphs"], lambda h, i: F.when(~F.array_contains(tree_b["paragraphs"], h), i))
    return F.when(tree_a["root"] == tree_b["root"], F.array().cast("array<int>")).otherwise(F.array_compact(numbered))


def _range_of(first: list, at: Column, tie: Column) -> Column:
    """Number of the last range that begins at or before (at, tie), by binary search."""
    ids, ties = (F.lit(np.array(part, dtype=np.int64)) for part in zip(*first))
    steps = F.lit(np.array([1 << k for k in reversed(range(len(first).bit_length()))], dtype=np.int64)).cast("array<int>")

    def further(low: Column, step: Column) -> Column:
        to = low + step
        return F.when((F.get(ids, to) < at) | ((F.get(ids, to) == at) & (F.get(ties, to) <= tie)), to).otherwise(low)

    return F.aggregate(steps, F.lit(0), further)


def with_next(docs: DataFrame, per_bucket: int = 1024) -> DataFrame:
    """doc_id, text and the text of the next row by falling id.

    Ranges are cut at quantiles of id and hash of the text, so they hold about ``per_bucket``
    rows however the ids are spread (more beyond 65,536 ranges, which bound what reaches the
    driver: the least and greatest key of each). Only ids and hashes are shuffled for it. In a
    range a window finds the next row, and its last row takes the greatest of the range below."""
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LEAST)).alias("at"), F.xxhash64("text").alias("tie"))
    keys = docs.select("at", "tie")
    n_ranges = min(MAX_RANGES, -(-keys.count() // per_bucket) or 1)
    cut = keys.repartitionByRange(n_ranges, "at", "tie").groupBy(F.spark_partition_id().alias("range"))
    cut = sorted(cut.agg(F.min(F.struct("at", "tie")).alias("first"), F.max(F.struct("at", "tie")).alias("top")).select("first", "top").collect())
    first, top = ([r[i] for r in cut] or [(LEAST, LEAST)] for i in (0, 1))
    at, tie = F.col("at"), F.col("tie")
    placed = docs.withColumn("bucket", _range_of(first, at, tie))
    top_at, top_tie = (F.get(F.lit(np.array(part, dtype=np.int64)), F.col("bucket")) for part in zip(*top))
    heads = placed.filter((at == top_at) & (tie == top_tie)).groupBy("bucket").agg(F.max("text").alias("head"))
    after = heads.select(((F.col("bucket") + 1) % len(first)).alias("bucket"), "head")
    inner = placed.withColumn("beside", F.lead("text").over(Window.partitionBy("bucket").orderBy(F.desc("at"), F.desc("tie"))))
    return inner.join(after, "bucket").select("doc_id", "text", F.coalesce("beside", "head").alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trees and phrases of every text, of its edited text and of the next document.

    The edited text has its last half replaced by as much of the next document's beginning."""
    n = F.char_length("text")
    rows = with_next(id_text(docs, id_col, text_col)).withColumn("n_chars", n.cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"{name}_tree", tree(F.col(name))).withColumn(f"{name}_phrases", phrases(F.col(name)))
    return rows


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints with their likenesses."""
    rows = fingerprints(docs, id_col, text_col)
    near = lambda other: likeness(F.col("text_tree.root"), F.col("text_phrases"), F.col(f"{other}_tree.root"), F.col(f"{other}_phrases"))
    return rows.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("text_tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next_text").alias("near_next"),
        F.size(changed(F.col("text_tree"), F.col("edited_tree"))).alias("n_changed_paragraphs"),
    )
