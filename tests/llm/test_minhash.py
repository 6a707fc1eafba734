"""Near duplicates against all pairs on a small table."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pitchlake.llm import minhash

from conftest import SF001


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """{id: (set sizes, component)} by all pairs and union-find."""
    sets, parent = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(plain_set(t))
        parent[i] = i

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, own in sets.items():
        for s in own:
            for x in s:
                holders.setdefault(x, set()).add(i)
    near = {(a, b) for ids in holders.values() for a in ids for b in ids if b < a}
    for a, b in near:
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {i: (sorted(map(len, s)), top(i)) for i, s in sets.items()}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute([r for r in rows if r[0] is not None])
    got = minhash.linked(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        sizes.setdefault(r.doc_id, []).append(r.n_shingles)
        assert r.component_id == want[r.doc_id][1] and r.kept == (r.component_id == r.doc_id)
    assert {i: sorted(s) for i, s in sizes.items()} == {i: w[0] for i, w in want.items()}


def test_links_equal_brute_force(odd):
    check(odd)


def test_links_on_documents(spark):
    check(spark.read.parquet(f"{SF001}/documents.parquet"))


@pytest.mark.parametrize("block", [4096, 16])
def test_chains_and_groups_at_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    rows, n = [], 0
    for group in range(6):
        words = [f"g{group}w{i}" for i in range(120)]
        for k in range(40):  # a chain: far ends are unlike, and pairs lie on both sides of the threshold
            for _ in range(rng.randrange(1, 3) if group % 2 else 1):
                words[rng.randrange(len(words))] = f"n{n}x{k}"
            rows.append((n, " ".join(words)))
            n += 1
        for _ in range(20):  # a star: all near its centre, pairs of them at about the threshold
            copy = list(words)
            for at in rng.sample(range(120), 3):
                copy[at] = f"c{n}y{at}"
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_hostile_and_empty(spark, hostile, empty):
    check(hostile)
    assert minhash.linked(empty).count() == 0
    kept = minhash.without_copies(hostile)
    assert kept.columns == hostile.columns and 0 < kept.count() < hostile.count()


def test_one_id_with_two_texts(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    check(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, b), (4, None)], "doc_id long, text string"))


def test_components_of_long_path(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "a long, b long")
    assert {(r.doc_id, r.component) for r in minhash.components(links).collect()} == {(i, 0) for i in range(n)}


def test_signature_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, size=400, dtype=np.uint64)
        x, y = np.sort(pool[:350]), np.sort(pool[50:])
        off.append((minhash.signature(x) == minhash.signature(y)).mean() - 300 / 400)
    assert abs(np.mean(off)) < 0.02


def test_pairs_that_share_a_bucket_come_up_in_one():
    """A band may agree in the signature's short bytes alone; no bucket comes of it, so it must not stand for one that does."""
    rng = np.random.default_rng(3)
    n_bands, chance = 2 * minhash.PERMUTATIONS // minhash.BAND, 0
    for _ in range(1500):
        one = rng.integers(0, 1 << 32, size=2 * minhash.PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
        other = np.where(rng.random(len(one)) < 0.75, one, rng.integers(0, 1 << 32, size=len(one), dtype=np.uint64).astype(np.uint32))
        brief = [(v * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8) for v in (one, other)]
        keys = [minhash.bands(v) for v in (one, other)]
        shared = np.flatnonzero(keys[0] == keys[1]).tolist()
        alike = brief[0] == brief[1]
        if not shared or alike.mean() < minhash.LIKELY:
            continue
        chance += int(alike.reshape(n_bands, minhash.BAND).all(axis=1).argmax()) != shared[0]
        found = 0
        for band in shared:
            columns = {"band": [band] * 2, "part": [{"i": 0, "j": 0}] * 2, "component": [1, 2], "block": [0, 0], "bands": [k.tolist() for k in keys], "brief": [b.tobytes() for b in brief]}
            a, b, _ = minhash._likely(pa.table(columns))
            found += len({(min(x), max(x)) for x in zip(a.tolist(), b.tolist())})
        assert found == 1
    assert chance


def test_sets_follow_ascii_rules():
    assert len(minhash.shingles("a b c d e F")) == 2 and len(minhash.shingles("A b")) == 1
    assert minhash.shingles("A B c d e").tolist() == minhash.shingles("a b C\nd\x0be").tolist()
    assert minhash.shingles("É b c d e").tolist() != minhash.shingles("é b c d e").tolist()
    assert len(minhash.shingles("a\xa0b c")) == 1 and len(minhash.shingles(" \t")) == 0


def test_long_words_are_not_remembered():
    """Words of any length are hashed; the memory holds short ones only, so it is bounded in bytes."""
    minhash._WORDS.clear()
    text = " ".join(f"{i:06d}" + "x" * 50_000 for i in range(100))
    assert len(minhash.shingles(text)) == 96 and not minhash._WORDS
    assert minhash.shingles(text).tolist() == minhash.shingles(text).tolist()
    assert len(minhash.shingles("a b c d e f")) == 2 and len(minhash._WORDS) == 6
