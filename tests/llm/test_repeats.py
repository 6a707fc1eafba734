"""Repeat removal against a brute-force walk over all windows."""

import random

import pytest

from pitchlake.llm import repeats

from conftest import SF0001


def brute(docs, length):
    """{(id, text): (bytes, removed, stretches, bytes left)}; ids in order, equal ids by text."""
    seen, out = {}, {}
    for doc_id, text in sorted({(repeats.LAST_ID if i is None else i, (t or "").encode()) for i, t in docs}):
        own = [text[i : i + length] for i in range(len(text) - length + 1)]
        off = bytearray(len(text))
        for i, w in enumerate(own):
            if w in seen:
                off[i : i + length] = b"\1" * length
            seen.setdefault(w, i)
        left = bytes(b for b, o in zip(text, off) if not o)
        out[doc_id, text] = (len(text), sum(off), sum(o and not (i and off[i - 1]) for i, o in enumerate(off)), left)
    return out


def check(df, length, **more):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows, length)
    got = repeats.remove_repeats(df, length=length, **more).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        want[repeats.LAST_ID if i is None else i, (t or "").encode()] for i, t in rows
    )
    return got


@pytest.mark.parametrize("many", [1, 2, 2048])
def test_repeats_equal_brute_force(odd, many):
    got = check(odd, 100, many=many)
    assert sum(r.n_removed for r in got) > 10_000


def test_repeats_hostile_and_empty(hostile, empty):
    got = check(hostile, 70)
    assert got[0].row.start == "clash"
    assert repeats.remove_repeats(empty).count() == 0
    again = repeats.without_repeats(hostile)
    assert again.columns == hostile.columns and again.count() == hostile.count()
    assert repeats.without_repeats(empty).count() == 0


def test_repeats_on_documents(spark):
    check(spark.read.parquet(f"{SF0001}/documents.parquet"), 100)


def test_repeats_periods_pieces_and_shared_edges(spark, monkeypatch):
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("uvwxyz ") for _ in range(rng.randrange(150))) + line[rng.randrange(60) :] + str(rng.random())) for i in range(300)]
    rows += [(1000 + i, "abcdefg"[: i + 1] * 400) for i in range(7)] + [(2000, line * 20), (2001, "\0" * 500), (2002, "é" * 50 + line)]
    monkeypatch.setattr(repeats, "PIECE", 1000)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 100, many=50)


def test_longest_previous_factor():
    text = "abaababaabaab$"
    order = sorted(range(len(text)), key=lambda i: text[i:])

    def common(a, b):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        return n

    prefix = [0] + [common(a, b) for a, b in zip(order, order[1:])]
    want = [max([common(i, j) for j in range(i)], default=0) for i in range(len(text))]
    assert repeats.longest_previous(order, prefix) == want
