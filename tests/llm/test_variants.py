"""Spelling variants against plain Python over all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, min_chars=5, min_count=3, one_in=97):
    total = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_chars and n >= min_count}


def plain_neighbours(words):
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        found = {w[:i] + w[i + 1 :] for i in range(len(w))}
        found |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        found |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = {u for u in found if u in words and u != w}
    return near


def plain(rows, ratio=2, **given):
    words = plain_counts(rows, **given)
    near = plain_neighbours(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def got(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("alphabet,low,high,one_in", [("abc", 1, 9, 97), ("abÀéÿz", 3, 8, 3), ("ab", 1, 14, 5)])
def test_equal_plain(spark, alphabet, low, high, one_in):
    rng = random.Random(len(alphabet))
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(260)]
    rows = [(i, " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for min_chars in (1, 5):
        found = got(variants.grouped(docs, min_chars=min_chars, one_in=one_in))
        expected = plain(rows, min_chars=min_chars, one_in=one_in)
        expected = {r for r in expected if r[0]}
        assert len(found) == len(set(found)) and set(found) == expected


def test_odd_rows_and_long_words(spark, hostile):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdé") for _ in range(3000))
    edits = [long, long[:2000] + long[2001:], long[:100] + "z" + long[101:], long[:-1], "x" + long, long[::-1]]
    more = [(900 + i, f"{w} {w}.{w}") for i, w in enumerate(edits)] + [(None, "Größe größe GRößE"), (7, None), (8, ""), (9, "a×b÷c a×b÷c a×b÷c Œuvre œuvre ﬁnden ı")]
    rows = [(r.doc_id, r.text) for r in hostile.select("doc_id", "text").collect()] + more
    docs = hostile.select("doc_id", "text", "kept", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    one_in = 1_000_003  # no long word loses a character
    found = got(variants.grouped(docs.withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash")), one_in=one_in))
    assert len(found) == len(set(found)) and set(found) == plain(rows, one_in=one_in)
    assert [near for w, _, _, _, near, _ in found if w == long] == [4]


def test_empty(spark, empty):
    assert got(variants.grouped(empty)) == []
    assert got(variants.grouped(spark.createDataFrame([(1, "aaaaa bbbbb")], "doc_id long, text string"))) == []


def test_query_equals_plain(spark):
    from pitchlake.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = got(QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001"))
    assert len(found) > 300 and set(found) == plain(rows)


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """With Spark's own broadcast threshold, words as few as these: no join may send a side to the driver."""
    plans, keep = [], variants.written

    def plan_of(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    def recorded(df, name):
        plans.append((name, plan_of(df)))
        return keep(df, name)

    monkeypatch.setattr(variants, "written", recorded)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    rows = [(i, "abcde abcde abcdf abcd abcdef abcdef abcdef abcdef bbbbb bbbbc " * (1 + i % 2)) for i in range(6)]
    found = variants.grouped(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=4, one_in=1_000_003)
    plans.append(("grouped", plan_of(found)))
    assert {"paths", "states", "forms", "roots", "grouped"} <= {n for n, p in plans if "SortMergeJoin" in p}
    assert [n for n, p in plans if "Broadcast" in p] == []
