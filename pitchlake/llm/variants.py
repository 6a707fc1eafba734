"""Spelling variants: words one edit apart, found by a frontier of trie states.

The words are kept in two radix tries, one of the words and one of the reversed
words, as a distributed edge table (node, first character, label, child). A state
is (word, position, node, edits). With no edit made a state is a node on the word's
own path, which is known from building the trie. At such a node every edge that
leaves the path replaces or skips a character and gives a state with one edit;
those states are joined with the edge table level by level, each level following
the edge whose label equals what is left of the word. A state that ends at a word
makes the two words neighbours.

* Two words one edit apart share the first or the last half but for the edit, so a
  word enters a trie only at its half and every edit lies beyond it.
* Skipping a character leads to the shorter word and the greater character replaces
  the smaller; the other directions are the same pairs read backwards.
* Each node knows which lengths are left below it, so a state that cannot end goes
  at once. Unary chains are one edge, so long words need no more levels than short ones.

Nodes are 61-bit rolling hashes of their prefixes; found words are looked up as
strings, so a collision can never make a pair (it can lose one: at ten million nodes
with a probability of about 2e-5).

A word's form is its most frequent neighbour where that is at least ``ratio`` times as
frequent; counts at least double along a chain of forms, so pointer jumping finds
the roots in a few rounds.

Every join here has two sides that grow with the vocabulary, so all are sort-merge joins by hint
(:func:`_met`). Spark sees neither what an explode makes of a row nor what compressed files and shuffles
hold, so left to itself it sends tables of gigabytes through the driver as broadcasts.

Null texts have no words. Null ids count as the empty string in the check sum that
drops characters. Repeated rows count each time, ties are settled by code-point order,
columns other than id and text are not read (so their names cannot clash), and an empty
table gives an empty result."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, remembers, rows, written

#: modulus and base of the rolling hash; a seed for each trie
MODULUS, BASE, SEEDS = (1 << 61) - 1, 0x2545F4914F6CDD1D % ((1 << 61) - 1), (7, 11)
#: lengths left below a node are bits; all from here on share the last one
LAST_BIT = 62

_ELSEWHERE = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
#: bytes of letters stay (A to Z as a to z), with the two bytes of U+00C0 to U+00FF; all others end a word
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256)
)


def runs(text: str) -> Counter:
    """Lower-cased runs of letters (UTF-8) and how often each occurs."""
    raw = text.encode()
    if not raw.isascii():
        raw = _ELSEWHERE.sub(b" ", raw)
    return Counter(raw.translate(_LETTERS).split())


def variant(run: bytes, id_sum: int, one_in: int) -> bytes:
    """The run, without one code point where the check sum of id and run says so."""
    h = zlib.crc32(run, id_sum)
    if h % one_in:
        return run
    if run.isascii():
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(
    docs: DataFrame, min_chars: int = 5, min_count: int = 3, one_in: int = 97, held: int = 200_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word and n (occurrences in all documents). A task holds at most ``held`` distinct words, and a text, at a time."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        remembers("variants", lambda: None)
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            words, ns = list(total), list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], schema=schema)

        for doc_id, text in rows(batches, "doc_id", "text", at_once=64):
            id_sum = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for run, n in runs(text).items():
                if len(run) >= min_chars:
                    total[variant(run, id_sum, one_in)] += n
            if len(total) >= held:
                yield out()
        yield out()

    counted = id_text(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    # in the bytes above a long run may have few code points
    return counted.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join, with both sides dealt by key and sorted, however small Spark takes them to be."""
    return left.join(right.hint("merge"), on, how)


def _entries(words: DataFrame) -> DataFrame:
    """For each word and trie: the nodes from the word's half on, the character that follows each, and at the last one the word."""
    schema = pa.schema([
        ("trie", pa.int8()), ("length", pa.int32()), ("from", pa.int32()), ("key", pa.int64()),
        ("nodes", pa.list_(pa.int64())), ("next", pa.list_(pa.string())), ("word", pa.list_(pa.string())),
    ])

    def made(batches: Iterator[pa.RecordBatch]):
        for (word,) in rows(batches, "word", at_once=4096):
            for trie, seed in enumerate(SEEDS):
                w = word[::-1] if trie else word
                start = (len(w) - 1) // 2 + 1 if trie else len(w) // 2  # the halves overlap by no edit
                h, nodes = seed, []
                for c in w[:start]:
                    h = (h * BASE + ord(c)) % MODULUS
                nodes.append(h)
                for c in w[start:]:
                    h = (h * BASE + ord(c)) % MODULUS
                    nodes.append(h)
                yield trie, len(w), start, h, nodes, list(w[start:]) + [None], [None] * (len(w) - start) + [w]

    def batches_of(batches):
        held, size = [], 0
        for r in made(batches):
            held.append(r)
            size += len(r[4])
            if size >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    ddl = "trie byte, length int, from int, key long, nodes array<long>, next array<string>, word array<string>"
    return words.select("word").mapInArrow(batches_of, ddl)


def _bit(left: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.least(left, F.lit(LAST_BIT)).cast("int"))


def tries(words: DataFrame) -> DataFrame:
    """A row for each word and trie: trie, word (as spelled there), length, and its path.

    The path lists the kept nodes (branching, a word's end or the entry) as pos, node,
    lengths left below it, whether it branches, and whether this word stands for the edge into it."""
    at = F.explode(F.arrays_zip(F.sequence("from", "length").alias("pos"), "nodes", "next", "word")).alias("at")
    steps = _entries(words).select("trie", "key", "length", "from", at)
    claim = F.call_function("shiftleft", F.col("from").cast("long"), F.lit(40)) + F.col("key").bitwiseAND((1 << 40) - 1)
    steps = steps.select(
        "trie", "key", "length", F.col("at.pos").alias("pos"), F.col("at.nodes").alias("node"),
        F.col("at.next").alias("next"), F.col("at.word").alias("word"), claim.alias("claim"),
    )
    nodes = steps.groupBy("trie", "pos", "node").agg(
        F.bit_or(_bit(F.col("length") - F.col("pos"))).alias("left"),
        F.min("claim").alias("claim"),
        F.min(F.ascii("next")).alias("low"), F.max(F.ascii("next")).alias("high"),
    )
    nodes = nodes.withColumn("branches", F.coalesce(F.col("low") < F.col("high"), F.lit(False)))
    nodes = nodes.select("trie", "pos", "node", "left", "branches", F.col("claim").alias("least")).filter(F.col("branches") | (F.col("left").bitwiseAND(1) == 1))
    kept = _met(steps.drop("next"), nodes, ["trie", "pos", "node"])
    place = F.struct("pos", "node", "left", "branches", (F.col("claim") == F.col("least")).alias("stands"))
    path = F.sort_array(F.collect_list(place)).alias("path")
    return kept.groupBy("trie", "key", "length").agg(F.max("word").alias("word"), path).select("trie", "word", "length", "path")


def edges(paths: DataFrame) -> DataFrame:
    """node, first character, label, child and the lengths left below the child; an edge comes once or, rarely, twice."""
    pair = F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))).alias("p")
    found = paths.filter(F.size("path") > 1).select("trie", "word", pair).filter("p.b.stands")
    label = F.substring("word", F.col("p.a.pos") + 1, F.col("p.b.pos") - F.col("p.a.pos"))
    found = found.select("trie", F.col("p.a.node").alias("node"), label.alias("label"), F.col("p.b.node").alias("child"), F.col("p.b.left").alias("left"))
    return found.withColumn("first", F.substring("label", 1, 1)).withColumn("size", F.char_length("label"))


def _ends(length: Column) -> Column:
    """Whether a word with so many characters left lies below the edge's child."""
    return (length >= 0) & (F.col("left").bitwiseAND(_bit(F.greatest(length, F.lit(0)))) != 0)


def first_edits(paths: DataFrame, edge: DataFrame) -> DataFrame:
    """States with one edit: trie, word, other (the word as edited), pos (in other), node."""
    own = paths.select("trie", "word", "length", F.explode(F.filter("path", lambda p: p["branches"] & (p["pos"] < F.col("length")))).alias("at"))
    own = own.select("trie", "word", "length", F.col("at.pos").alias("pos"), F.col("at.node").alias("node"))
    own = own.withColumn("here", F.substring("word", F.col("pos") + 1, F.lit(1))).withColumn("after", F.substring("word", F.col("pos") + 2, F.lit(1)))
    pos, size, word = F.col("pos"), F.col("size"), F.col("word")
    replaces = (F.col("first") > F.col("here")) & _ends(F.col("length") - pos - size)
    replaces &= F.substring("word", pos + 2, size - 1) == F.substring("label", F.lit(2), size - 1)
    skips = (F.col("first") == F.col("after")) & (F.col("here") != F.col("after")) & _ends(F.col("length") - pos - 1 - size)
    skips &= F.substring("word", pos + 2, size) == F.col("label")
    begin, rest = F.substring(word, F.lit(1), pos), F.substring(word, pos + 2, F.col("length"))
    made = F.array(
        F.when(replaces, F.concat(begin, F.col("first"), rest)),
        F.when(skips, F.concat(begin, rest)),
    )
    joined = _met(own, edge, ["trie", "node"]).filter(replaces | skips)
    states = joined.select("trie", "word", F.explode(F.array_compact(made)).alias("other"), (pos + size).alias("pos"), F.col("child").alias("node"))
    # the word less its last character may be a word itself: a skip with nothing left to follow
    last = paths.select("trie", "word", "length", F.explode(F.filter("path", lambda p: (p["pos"] == F.col("length") - 1) & (p["left"].bitwiseAND(1) == 1))).alias("at"))
    last = last.select("trie", "word", F.substring(word, F.lit(1), F.col("length") - 1).alias("other"), F.col("at.pos").alias("pos"), F.col("at.node").alias("node"))
    return states.unionByName(last)


def next_level(states: DataFrame, edge: DataFrame) -> DataFrame:
    """Each state that is not at its word's end, past the edge that begins with its next character."""
    going = states.filter(F.col("pos") < F.char_length("other")).withColumn("first", F.substring("other", F.col("pos") + 1, F.lit(1)))
    joined = _met(going, edge, ["trie", "node", "first"])
    same = F.substring("other", F.col("pos") + 1, F.col("size")) == F.col("label")
    joined = joined.filter(same & _ends(F.char_length("other") - F.col("pos") - F.col("size")))
    return joined.select("trie", "word", "other", (F.col("pos") + F.col("size")).alias("pos"), F.col("child").alias("node"))


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs word, other of distinct ``words`` one edit apart, in both directions."""
    paths = written(tries(words), "paths")
    edge = written(edges(paths), "edges")
    level = written(first_edits(paths, edge), "states")
    ended = []
    while True:
        ended.append(level.filter(F.col("pos") == F.char_length("other")))
        if level.filter(F.col("pos") < F.char_length("other")).isEmpty():
            break
        level = written(next_level(level, edge), "states")
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    forth = F.struct(F.col("word").alias("word"), F.col("other").alias("other"))
    back = F.struct(F.col("other").alias("word"), F.col("word").alias("other"))
    turned = lambda c: F.when(F.col("trie") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
    pairs = found.select(turned("word"), turned("other")).distinct()
    return pairs.select(F.explode(F.array(forth, back)).alias("p")).select("p.word", "p.other")


def forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, and form with form_n where a neighbour is ``ratio`` times as frequent."""
    near = _met(neighbours(words), words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = _met(words, best, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
    )


def grouped(
    docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, one_in: int = 97, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = written(word_counts(docs, min_chars, min_count, one_in, id_col=id_col, text_col=text_col), "words")
    known = written(forms(words, ratio), "forms")
    roots = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # the distance to the root doubles each round; it is at most log2 of the largest count
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = _met(roots, further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        stepped = written(stepped, "roots")
        roots = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return _met(known, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
