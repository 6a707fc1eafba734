"""Filter audit against documents filtered one by one."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from pitchlake.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    least, good, toxic = {}, set(), set()
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, quality, is_toxic in labels:
        good |= {doc_id} if quality == 1 else set()
        toxic |= {doc_id} if is_toxic == 1 else set()
    judged = []
    for doc_id, text, part in docs:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and least[text] < doc_id,
        }
        judged.append((part or "", {f for f in fails if fails[f]}, doc_id in good and doc_id is not None, doc_id in toxic and doc_id is not None))
    out = {}
    for part in {j[0] for j in judged}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            everything = left
            for step, f in enumerate(order, 1):
                removed = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                failing = sum(f in j[1] for j in everything)
                alone = sum(j[1] == {f} for j in everything)
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), alone, sum(j[2] for j in removed), sum(j[3] for j in removed)]
                shapley[f] += len(removed)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r[m] for m in filter_audit.MEASURES] for r in rows}
    assert len(rows) == len(out)
    return out


def test_equal_plain(spark, hostile):
    labels = [(3, 1, 0), (3, 0, 1), (5, 0, 1), (20, 1, None), (None, 1, 1), (41, 1, 0), (10**9, 1, 1)]
    long = " ".join(f"w{i}" for i in range(150))
    more = [(70, long, "en"), (71, long, "de"), (71, long, "de"), (72, long, None), (None, long, "en"), (69, long.upper(), "en"), (73, long + "#", "fr")]
    docs = hostile.select("doc_id", "text", "lang", "kept", "label").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    docs = docs.withColumns({c: F.lit("clash") for c in ("part", "digest", "quality", "n", "first")})
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("digest", F.lit("clash"))
    expected = plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)
    assert found(filter_audit.audit(docs, table)) == expected
    assert len(expected) == 600 * 4


def test_one_text_holds_most_rows(spark):
    docs = [(i, "the same text", "en" if i % 2 else "de") for i in range(400)] + [(1000 + i, f"other {i}", "en") for i in range(50)]
    labels = [(i, i % 2, 0) for i in range(0, 400, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    assert found(filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == plain(docs, labels)


def test_contraction_equals_masks():
    tensor = np.random.default_rng(0).integers(0, 9, (3, 2, 2, 2, 2, 2))
    own, removed, kept = filter_audit._selectors()
    sums = filter_audit.contract(tensor, removed)
    for i in (0, 77, 599):
        picked = tensor
        for axis in range(5):
            picked = np.tensordot(picked, removed[i, axis], axes=([1], [0]))
        assert (picked == sums[:, i]).all()


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
