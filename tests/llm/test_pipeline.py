"""The pipeline's stages against brute force, stage by stage on the same input."""

import importlib.util
import re
from pathlib import Path

import pytest

from pitchlake.llm import packing, pii, quality

from conftest import SF001
from llm.test_minhash import brute as brute_links
from llm.test_repeats import brute as brute_repeats


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def test_stages_take_effect(spark, pipeline):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    by_name, columns = dict(pipeline.STAGES), docs.columns
    field = quality.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    good = by_name["quality_rules"](spark, docs, SF001).cache()
    want = [r for r in docs.collect() if quality.judge(r.text, field, 50, 50, 0.5).kept]
    assert sorted(good.collect()) == sorted(want) and good.columns == columns

    unique = by_name["near_dedup"](spark, good, SF001).cache()
    links = brute_links([(r.doc_id, r.text) for r in want])
    want = [r for r in want if links[r.doc_id][1] == r.doc_id]
    assert sorted(unique.collect()) == sorted(want) and unique.columns == columns

    cut = by_name["suffix_dedup"](spark, unique, SF001).cache()
    left = {i: b[3].decode(errors="ignore") for (i, _), b in brute_repeats([(r.doc_id, r.text) for r in want], 100).items()}
    assert {r.doc_id: r.text for r in cut.collect()} == left and cut.columns == columns
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    clean = by_name["pii"](spark, cut, SF001).cache()
    model = pii.fit(pii.found(cut))
    assert {r.doc_id: r.text for r in clean.collect()} == {i: pii.redacted_text(t, model) for i, t in left.items()}
    assert clean.columns == columns and not clean.filter("text RLIKE '[a-z]@[a-z]+[.]'").count()

    pieces = by_name["packing"](spark, clean, SF001).collect()
    whole = {r.doc_id: 0 for r in clean.collect()}
    for r in pieces:
        whole[r.doc_id] += r.length
    assert {r.doc_id: r.doc_tokens for r in pieces} == whole


def test_run_and_registration(spark, pipeline):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is pipeline.run
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == packing.PIECE.names and got.count() > 0


def test_stages_on_hostile_and_empty(spark, pipeline, hostile, empty):
    for docs in (hostile, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == (packing.PIECE.names if name == "packing" else docs.columns)
            assert out.count() <= max(2 * docs.count(), 0) + 20


def test_nothing_else_imports_the_subpackage():
    root = Path(importlib.util.find_spec("pitchlake").origin).parent
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert not re.search(r"\bllm\b", path.read_text())
