"""HTML extraction, personal data and fingerprints."""

import hashlib
import html as entities
import random
import re
from collections import Counter

import pytest

from pitchlake.llm import html, merkle, pii

from conftest import SF001

# -- html ------------------------------------------------------------------


def article_of(page):
    """The article of a synthetic page, by its known template."""
    inner = page.split("<article>", 1)[1].split("</article>")[0]
    if "</article>" not in page:
        inner = re.sub(r"<[^>]*$", "", inner.split("<footer")[0])
    parts = re.split(r"</?(?:p|h1)>", inner)
    text = (re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in parts)
    return "\n".join(t for t in text if t)


def test_html_on_pages(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    want = {r.page_id: (r.url, article_of(r.html)) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text) for r in html.extract(pages).collect()}
    assert got == want


PROSE = "The river rose, and nobody saw it. By noon the bridge was under water; the road, too, had gone."
PAGE = f"""<html><head><title>T</title><style>p{{}}</style><body><header><h1>Site name</h1></header>
<nav><a href=/>Home</a></nav><div id="cookie-notice"><p>We use cookies, as everyone does. Accept them, please.</p></div>
<div class="content"><h2>Flood</h2><p>{PROSE}<p>{PROSE} <a href=x>More</a> of&nbsp;it &amp; <b>more.<ul><li>One, first.<li>Two, last.</ul>
<aside>Read this, too.</aside><script>if (a < b) document.write("<p>no</p>")</script><form><p>Search, now.</p></form>
<div class="ad-box">Buy, buy!</div><p hidden>Unseen, unheard.</p></div>
<div class="sidebar"><p>{PROSE}</p></div><section id=comments><p>{PROSE} says a reader.</p></section><footer>&copy; us</footer></html>"""


def test_html_without_boilerplate():
    assert html.main_text(PAGE) == f"Flood\n{PROSE}\n{PROSE} More of it & more.\nOne, first.\nTwo, last."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain  text &lt; here", "plain text < here"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<a" * 3000, ""),
        ("<nav>only a menu</nav>", ""), ("<p>one &am", "one &am"), ("<!-- <p>x</p> --><p>y</p>", "y"), ('<p title="a>b">c</p>', "c"),
        ("<article><p>Short.</p></article><p>" + PROSE + "</p>", "Short.\n" + PROSE), ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_html_odd_pages(page, text):
    if page and page.startswith("<article>"):
        assert html.main_text(page) in (text, PROSE)
    else:
        assert html.main_text(page) == text


def test_html_keeps_short_items_of_the_article():
    items = "".join(f"<li>{w}</li>" for w in ("ink", "paper", "glue"))
    links = "".join(f"<li><a href=/{n}>Story {n}</a></li>" for n in range(9))
    page = f"<body><div id=top><ul>{links}</ul></div><div id=main><h3>Kit</h3><p>{PROSE}</p><ul>{items}</ul><p>{PROSE}</p></div><div id=more><ul>{links}</ul></div></body>"
    assert html.main_text(page) == f"Kit\n{PROSE}\nink\npaper\nglue\n{PROSE}"


@pytest.mark.parametrize(
    "page,text",
    [
        (f'<div class="content-sidebar-wrap"><p>{PROSE}</p></div>', PROSE),
        (f'<div id="page" class="no-sidebar"><div class="main-col"><p>{PROSE}</p></div><div class="sidebar"><p>Much more. {PROSE} {PROSE}</p></div></div>', PROSE),
        (f'<div class="content-sidebar-wrap"><div class="no-sidebar"><p>{PROSE}</p></div><div class="cookie-notice">Cookies, too.</div></div>', PROSE),
        (f'<div class="text"><p>{PROSE}</p></div><div class="comments-area"><p>{PROSE} {PROSE}</p></div>', PROSE),
        (f'<article><h2 id="legal-history">History</h2><p>{PROSE}</p><section id="related-work"><p>{PROSE}</p></section></article>', f"History\n{PROSE}\n{PROSE}"),
        (f"<p>{PROSE}</p><svg><p>{PROSE}</p>", f"{PROSE}\n{PROSE}"),
        (f"<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>, then. {PROSE}</p>", f"So x=2 , then. {PROSE}"),
    ],
)
def test_html_names_and_unclosed_elements_do_not_take_the_article(page, text):
    assert html.main_text(page) == text


def test_html_hostile_and_empty(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, None, "", "x"), (3, "u", "<p>" + "long text, it is. " * 20_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == 5 and max(r.n_chars for r in got) == 360_000 - 1
    assert html.extract(pages.limit(0)).count() == 0


# -- personal data ---------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030", "+", "7", " ", ".", "-", "12", "é", "\n", "_", "%", "5.6.7.8.9.10.11.12", "a@b.c.d", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text)[0] == plain_spans(text), text


def test_base_spans_in_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "1 " * 150_000 + "x"):
        pii.candidates(text)


def test_personal_data_on_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain_spans(texts[r.doc_id])
        joined = pii.listed(spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_method_adds_likely_spans(spark):
    rows = [(i, f"call me, my phone is {200 + i} 555-01{i:02d} or mail jo{i}@host{i}.com now") for i in range(60)]
    rows = [(i, t.replace(f"{200 + i} 555", f"{200 + i} 555")) for i, t in rows]
    rows += [(100 + i, f"write to jo{i} [at] host{i}.org or call +1 (555) 010-20{i:02d}") for i in range(40)]
    rows += [(200 + i, f"see section {100 + i}.555-0{i:03d}x and version {i}.0.0.{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert all(got[100 + i].n_added == 1 and got[100 + i].spans.startswith("email:9:") for i in range(40))
    assert all(got[i].n_added == 1 for i in range(60))


@pytest.mark.parametrize("text", ["0049 555 123 4567", "001-555-123-4567", "2024-01-05 555-123-4567", "555 123 4567 555 123 4568"])
def test_phones_inside_longer_runs_are_judged(text):
    spans = [s for s, fixed, _ in pii.candidates(text) if s[0] == 3 and not fixed]
    assert spans and spans[-1][2] == len(text)
    weights = pii.np.zeros(len(pii.KINDS) + 3 * pii.VOTES + 3)
    weights[3], weights[-1] = 2.0, -1.0  # phones only
    done = pii.redacted_text(text, pii.SpanModel(weights, pii.np.zeros((2, pii.VOTES, 3))))
    assert done.endswith("[PHONE]") and "4567" not in done


def test_accepted_spans_inside_others_are_left_out():
    assert pii.settled([(3, 4, 9), (2, 0, 9), (3, 0, 9), (3, 7, 12)]) == [(2, 0, 9), (3, 7, 12)]


def test_redaction(spark, hostile, empty):
    model = pii.train([])
    assert pii.redacted_text("to a@b.cd, +1 (555) 010-2030.", model) == "to [EMAIL], [PHONE]."
    out = pii.redact(hostile, model)
    assert out.columns == hostile.columns and out.count() == hostile.count()
    assert out.filter("text IS NULL").count() == hostile.filter("text IS NULL").count()
    assert pii.personal_data(hostile).count() == hostile.count()
    assert pii.personal_data(empty).count() == 0 and pii.redact(empty, model).count() == 0


def test_personal_data_hostile_values(hostile):
    """Repeated rows, null ids and clashing names: every row has the base spans of its own text."""
    got = Counter((r.doc_id, r.base_sha256) for r in pii.personal_data(hostile).collect())
    plain = lambda t: hashlib.sha256(pii.listed(plain_spans(t or "")).encode()).hexdigest()
    assert got == Counter((r.doc_id, plain(r.text)) for r in hostile.select("doc_id", "text").collect())


# -- fingerprints ----------------------------------------------------------


def plain_root(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections, run = [], []
    for p in text.split("\n"):
        run.append(sha(p))
        if run[-1][0] in "0123" or not p:
            sections.append(run)
            run = []
    if run:
        sections.append(run)
    return sha("".join(sha("".join(r)) for r in sections))


def plain_phrases(text):
    return set(re.split(r"\n|(?<=[.,;:!?dglnz])[ \t]+", text))


@pytest.mark.parametrize("per_bucket", [1024, 3])
def test_fingerprints_equal_plain(odd, monkeypatch, per_bucket):
    monkeypatch.setattr(merkle.with_next, "__defaults__", (per_bucket,))
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), reverse=True)
    got = {r.doc_id: r for r in merkle.compared(odd).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (plain_root(text), plain_root(edited))
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = plain_phrases(text), plain_phrases(other)
            assert near == pytest.approx(1.0 if text == other else 2 * len(a & b) / (len(a) + len(b)))


@pytest.mark.parametrize("per_bucket", [1024, 4, 1])
@pytest.mark.parametrize("ids", [
    [*range(50), 10**15],
    [*range(30), *range(10**12, 10**12 + 30), -(2**63), 2**63 - 1],
    [7],
    [5] * 20 + [6, None, None],
], ids=["far off", "clusters", "single", "repeated"])
def test_next_row_whatever_the_spread_of_ids(spark, ids, per_bucket):
    rows = [(x, f"text {i // 2}") for i, x in enumerate(ids)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = merkle.with_next(docs, per_bucket).withColumn("tie", merkle.F.xxhash64("text")).collect()
    least = -(2**64)
    order = sorted(got, key=lambda r: (least if r.doc_id is None else r.doc_id, r.tie), reverse=True)
    texts = [r.text for r in order]
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((d or -1, t) for d, t in rows)
    pairs = sorted((r.text, r.next_text) for r in got)
    assert pairs == sorted(zip(texts, texts[1:] + texts[:1]))


def test_far_off_ids_do_not_fill_one_window(spark, monkeypatch):
    """Ranges hold about as many rows as asked for, of ids in dense clusters and of repeated ids too."""
    cut = []
    found = merkle._range_of
    monkeypatch.setattr(merkle, "_range_of", lambda first, at, tie: cut.append(first) or found(first, at, tie))
    for doc_id in ("IF(id = 0, 1000000000000000, id)", "IF(id % 3 = 0, NULL, id)"):
        docs = spark.range(5000).selectExpr(f"{doc_id} AS doc_id", "string(id) AS text")
        assert merkle.with_next(docs, 100).count() == 5000
        place = found(cut[-1], merkle.F.coalesce("doc_id", merkle.F.lit(merkle.LEAST)), merkle.F.xxhash64("text"))
        sizes = [r["count"] for r in docs.groupBy(place.alias("range")).count().collect()]
        assert sum(sizes) == 5000 and len(sizes) == len(cut[-1]) > 30 and max(sizes) <= 300


def test_differing_paragraphs_are_located(spark):
    lines = [f"line {i}, of a text" for i in range(40)]
    other = list(lines)
    other[17] = "something else"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    trees = df.select(merkle.tree(merkle.F.col("a")).alias("a"), merkle.tree(merkle.F.col("b")).alias("b"))
    r = trees.select("a", "b", merkle.changed(merkle.F.col("a"), merkle.F.col("b")).alias("at")).first()
    assert r.at == [17] and len(set(r.a.sections) - set(r.b.sections)) == 1


def test_fingerprints_hostile_values(hostile):
    """Repeated rows, null ids and clashing names: every row has the root of its own text."""
    got = Counter((r.doc_id, r.n_chars, r.fingerprint) for r in merkle.compared(hostile).collect())
    assert got == Counter((r.doc_id, len(r.text or ""), plain_root(r.text or "")) for r in hostile.select("doc_id", "text").collect())


def test_fingerprints_hostile_and_empty(spark, hostile, empty):
    assert merkle.compared(hostile).count() == hostile.count()
    assert merkle.compared(empty).count() == 0
    one = merkle.compared(spark.createDataFrame([(5, "abc"), (None, None)], "doc_id long, text string")).collect()
    assert len(one) == 2


@pytest.mark.parametrize("page,expected", [
    ("<div>" * 100_000 + "x", "x"),
    ("<div>some text" * 100_000, None),
    ("<div class=ad>t " * 100_000, None),
    ("<svg>" * 100_000 + "after", "after"),
    ("<div>" * 100_000 + "in</b1></nav>" * 100_000, None),
    ("<li><ul>" + "<div>" * 100_000 + "<li>a</li>" * 100_000, None),
    ("<table><tr>" + "<td>a" * 100_000, None),
    ("<p>a</div>" * 100_000, None),
], ids=["nested", "nested text", "named", "unclosed raw", "unmatched", "siblings", "cells", "paragraphs"])
def test_a_hundred_thousand_levels_and_tags(page, expected):
    """Linear time and memory; a quadratic step would take many minutes here."""
    import time
    import tracemalloc

    began = time.process_time()
    text = html.main_text(page)
    assert time.process_time() - began < 20
    assert text == expected if expected is not None else text is not None
    tracemalloc.start()
    html.main_text(page[: len(page) // 4])
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
