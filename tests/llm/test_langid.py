"""Language identification: held-out accuracy, priors against plain Python, odd input."""

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import langid

from conftest import SF001


def test_text_accuracy_held_out(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").filter("length(text) > 100")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1").collect()
    right = [model.languages[int(np.argmax(model.scores(r.text)))] == r.lang for r in held]
    assert len(held) > 200 and np.mean(right) > 0.95


def test_pages(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = langid.identify(pages, langid.fit(spark.read.parquet(f"{SF001}/documents.parquet"))).collect()
    assert len(got) == pages.count()
    assert np.mean([r.lang == r.declared for r in got]) > 0.95 and all(0 < r.posterior <= 1 for r in got)


def test_evidence_is_fused(spark):
    """A page without text follows its host; a declaration that is seldom right weighs little against text."""
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string"))
    rows = [(i, "http://a.de/x", f"<html lang=de><p>der hund und die katze {i}") for i in range(30)]
    rows += [(100 + i, "http://b.com/x", f"<html lang=en><p>the cat and the dog {i}") for i in range(30)]
    rows += [(200, "http://a.de/y", ""), (201, "http://b.com/y", None), (202, "http://b.com/z", "<html lang=de><p>the cat and the dog and the cat")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, model).collect()}
    assert got[200].lang == "de" and got[201].lang == "en" and got[202].lang == "en"


def plain_buckets(text):
    full, text = 0xFFFFFFFF, " " + re.sub(r"[\s\d]+", " ", text.lower()) + " "
    for a, b, c in zip(text, text[1:], text[2:]):
        h = (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA6B ^ ord(c) * 0xC2B2AE35) & full
        yield (h * 0x27D4EB2F & full) >> 17


def softmax(scores):
    raised = [math.exp(x - max(scores)) for x in scores]
    return [x / sum(raised) for x in raised]


def plain_languages(docs, pages):
    """(text, lang) and (url, html) rows: lang, posterior, text_lang and declared of each page, step by step."""
    counts = defaultdict(Counter)
    for text, lang in docs:
        if text is not None and lang is not None:
            counts[lang].update(plain_buckets(text))
    langs = sorted(counts)
    seen = []
    for url, page in pages:
        host = langid.HOST.match(url or "")
        host = host[1].lower() if host else ""
        declared = langid.DECLARED.search(page or "")
        grams = list(plain_buckets(html.unescape(langid.DROPPED.sub(" ", page or ""))))
        scores = []
        for lang in langs:
            size = sum(counts[lang].values()) + 0.5 * langid.BUCKETS
            logs = [math.log((counts[lang][g] + 0.5) / size) for g in grams]
            scores.append(sum(logs) / len(logs) * min(len(logs), langid.TEMPERED) if logs else 0.0)
        seen.append((host, host.rpartition(".")[2], declared[1].lower() if declared else "", scores, softmax(scores)))
    for host, suffix, declared, scores, first in seen:
        def mass(same):
            """Posterior mass of the other pages that are alike."""
            return [max(sum(s[4][i] for s in seen if same(s)) - first[i], 0.0) for i in range(len(langs))]

        whole, total = mass(lambda s: True), [sum(s[4][i] for s in seen) for i in range(len(langs))]
        prior = [(x + 1) / (sum(total) - 1 + len(langs)) for x in whole]
        for level in (mass(lambda s: s[1] == suffix), mass(lambda s: s[0] == host)):
            prior = [(x + langid.LEANING * p) / (sum(level) + langid.LEANING) for x, p in zip(level, prior)]
        said = [(x + 0.1) / (t + 1) if declared else 1.0 for x, t in zip(mass(lambda s: s[2] == declared), total)]
        fused = [s + math.log(p) + math.log(d) for s, p, d in zip(scores, prior, said)]
        yield langs[fused.index(max(fused))], max(softmax(fused)), langs[scores.index(max(scores))], declared


def test_fusion_equals_plain(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text", "lang")
    odd = [(-1, None, None), (-2, "http://h.de/a", ""), (-2, "http://h.de/a", ""), (-3, "no host", "<html lang=xx><p>der die das"), (-4, "HTTP://u@H.DE:80/", "<p>" + "the cat " * 3000)]
    pages = spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame(odd, "page_id long, url string, html string"))
    rows = sorted(pages.collect(), key=lambda r: (r.page_id, r.html or ""))
    expected = list(plain_languages([tuple(r) for r in docs.collect()], [(r.url, r.html) for r in rows]))
    got = sorted(langid.identify(pages, langid.fit(docs)).collect(), key=lambda r: r.page_id)
    assert len(got) == len(rows) > 50
    for r, g, (lang, posterior, text_lang, declared) in zip(rows, got, expected):
        assert (g.page_id, g.url, g.lang, g.text_lang, g.declared) == (r.page_id, r.url, lang, text_lang, declared)
        assert g.posterior == pytest.approx(posterior, rel=1e-6)


def test_hostile_and_empty(spark):
    rows = [(1, "u", "<p>text", "x"), (1, "u", "<p>text", "x"), (None, None, None, None), (2, "http://h", "<p>" + "the cat " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string").withColumn("host", F.lit("clash"))
    docs = spark.createDataFrame([("the cat", "en"), (None, "de"), ("x", None), ("le chat", "fr")], "text string, lang string")
    assert langid.identify(pages, langid.fit(docs)).count() == 4
    assert langid.identify(pages.limit(0), langid.fit(docs)).count() == 0
    assert {r.lang for r in langid.identify(pages, langid.fit(docs.limit(0))).collect()} == {None}
