"""Quality rules, packing, byte-level BPE and id files against plain Python."""

import functools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from pitchlake.llm import bytebpe, idfiles, packing, quality, tokens
from pitchlake.llm.common import scratch_path, slices

from conftest import SF001

WORD_BPE = P.path("word_bpe_49k.json")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    return t


def library_ids(text):
    return [*library().encode(text, add_special_tokens=False).ids, 1]


# -- quality ---------------------------------------------------------------


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(odd):
    got = {r.doc_id: r for r in quality.judged(odd, quality.LineField.blank()).collect()}
    for doc_id, text in texts_of(odd).items():
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # a blank field calls every line content


def test_viterbi_is_best_of_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        field = quality.LineField(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.integers(0, quality.N_FEATURES, size=(n, len(quality.EDGES)))
        e = field.emit[x].sum(axis=1)

        def score(y):
            return field.first[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(field.move[y[i], y[i + 1]] for i in range(n - 1))

        every = [[b >> i & 1 for i in range(n)] for b in range(1 << n)]
        assert quality.viterbi(field, x).tolist() == max(every, key=score)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(docs, labels, max_labelled=600)
    seen = {r.doc_id for r in labels.selectExpr("doc_id").orderBy(quality.F.xxhash64("doc_id"), "doc_id").limit(600).collect()}
    got = quality.judged(docs, field).join(labels, "doc_id").select("doc_id", "quality", "base_failed", "kept").collect()
    held = [r for r in got if r.doc_id not in seen and not r.base_failed]
    good = [r.kept for r in held if r.quality == 1]
    assert len(good) > 500 and sum(good) / len(good) > 0.99
    bad = [r.kept for r in got if r.doc_id not in seen and r.quality == 0]
    assert sum(bad) / len(bad) < 0.1


def test_quality_hostile_and_empty(spark, hostile, empty):
    labels = spark.createDataFrame([(0, 1, 0), (63, 0, 0), (None, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")
    field = quality.fit(hostile, labels)
    assert quality.judged(hostile, field).count() == hostile.count()
    kept = quality.keep(hostile, field)
    assert kept.columns == hostile.columns and 0 < kept.count() < hostile.count()
    assert quality.judged(empty, quality.fit(empty, labels.limit(0))).count() == 0
    assert quality.keep(empty, field).count() == 0


def test_quality_fit_takes_one_row_of_an_id(spark, monkeypatch):
    """Repeated ids and labels leave the sample as it is: one text and one label of an id."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda sample: seen.append([(x.tolist(), y) for x, y in sample]))
    once = [(i, f"words of text {i}\n\n###") for i in range(8)]
    docs = spark.createDataFrame(once + [(3, "zzz later text")] * 50 + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(2, 1)] * 5 + [(4, 0)] * 5, "doc_id long, quality int")
    plain = spark.createDataFrame(once, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    for bound in (8, 3):
        quality.fit(docs, labels, max_labelled=bound)
        quality.fit(*plain, max_labelled=bound)
        assert seen[-2] == seen[-1] and len(seen[-1]) == bound


def test_quality_hostile_values(hostile):
    """Repeated rows, null ids and clashing names: every row has the measures of its own text."""
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judged(hostile, quality.train([])).collect())
    assert got == Counter((r.doc_id, *plain_measures(r.text or "")) for r in hostile.select("doc_id", "text").collect())


# -- packing ---------------------------------------------------------------


@pytest.mark.parametrize("window,most", [(2048, 64), (64, 3)])
def test_packing_is_whole(odd, window, most):
    pieces = packing.pack(odd, WORD_BPE, window=window, open_windows=most, merge_group=2).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in texts_of(odd).items():
        ids, at = library_ids(text), 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_best_fit_and_fullest():
    w = packing.OpenWindows(10, 2)
    ids = np.arange(100)
    placed = lambda doc, n: [[(d, s, len(i)) for d, s, i, _ in done] for done in w.place((doc, 0, ids[:n], n))]
    assert placed(1, 6) == [] and placed(2, 7) == []  # 4 and 3 free
    assert placed(3, 3) == [[(2, 0, 7), (3, 0, 3)]]  # best fit, not first fit
    assert placed(4, 9) == []
    assert placed(5, 6) == [[(4, 0, 9), (5, 0, 1)]]  # none fits: the fullest goes, the rest opens a window
    assert w.free == [4, 5] and [p[0] for p in w.rest()] == [1, 5]


def test_chunks_equal_library():
    enc, rng = tokens.ChunkEncoder(WORD_BPE, remembered=50), random.Random(8)
    letters = ["A", "z", "É", "ß", "ÿ", "İ", "ı", "Σ", "ſ", "K", "e\u0301", "T\u0308", "×", "÷", "ŉ", "'S", "'ll", "7", "½", "²", "!!", "<|endoftext|>", "\u00a0", "\x1c", "\x85", "€", "漢", "\u2028", "\x00", ".", "ªº", "ǅ"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randrange(8)))
        assert [*np.frombuffer(enc.encode(text), dtype=enc.kind).tolist(), 1] == library_ids(text), repr(text)


def test_packing_hostile_and_empty(hostile, empty):
    got = packing.pack(hostile, WORD_BPE)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in hostile.select("doc_id").collect()}
    assert packing.pack(empty, WORD_BPE).count() == 0


# -- byte-level BPE --------------------------------------------------------


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.load_ranks(MULTI), special_tokens={})


def test_bpe_equals_library(spark, odd):
    own = tiktoken_encoding()
    docs = odd.union(spark.read.parquet(f"{SF001}/documents.parquet").withColumn("doc_id", quality.F.col("doc_id") + 1000))
    coded = bytebpe.decode(bytebpe.encode(docs, MULTI, P.PATTERN), MULTI, P.PATTERN)
    texts = texts_of(docs)
    got = coded.collect()
    assert len(got) == len(texts)
    for r in got:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == own.encode_ordinary(texts[r.doc_id])
        assert r.bytes == texts[r.doc_id].encode()


def test_bpe_long_and_odd_matches():
    own, bpe, rng = tiktoken_encoding(), bytebpe.ByteBPE(MULTI, P.PATTERN, remembered=5), random.Random(3)
    texts = ["a" * 50_001, "".join(rng.choice("abcde") for _ in range(20_000)), "日本" * 3000, " " * 5000, "\0\x1f퟿ ", "<|endoftext|>"]
    texts += ["".join(rng.choice("aeiountéß ñ.,!'1\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    for lo in range(0, len(texts), 50):
        for t, ids in zip(texts[lo:], bpe.encode(texts[lo : lo + 50])):
            assert np.frombuffer(ids, dtype="<u4").tolist() == own.encode_ordinary(t)


def test_bpe_memory_is_bounded_by_bytes():
    """New matches share a queue up to so many bytes, however many a text has."""
    import tracemalloc

    rng, bpe = random.Random(5), bytebpe.ByteBPE(MULTI, P.PATTERN)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2000, 4000))) for _ in range(2000)]
    assert [s.stop - s.start for s in slices([5, 5, 20, 1, 1, 1, 1], 3, 10)] == [2, 1, 3, 1] and not list(slices([], 3, 10))

    def peak(n):
        tracemalloc.start()
        made = [zlib.crc32(ids) for ids in bpe.encode([" ".join(texts[:n])])]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return made, most

    (one,), small = peak(250)
    assert one == zlib.crc32(np.array(tiktoken_encoding().encode_ordinary(" ".join(texts[:250])), dtype="<u4").tobytes())
    assert peak(500)[1] < 1.6 * small + 8_000_000 and small < 120_000_000


def test_bpe_hostile_values(hostile):
    """Repeated rows, null ids and clashing names: every row has the ids of its own text."""
    own = tiktoken_encoding()
    expected = Counter((r.doc_id, np.array(own.encode_ordinary(r.text or ""), dtype="<u4").tobytes()) for r in hostile.select("doc_id", "text").collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in bytebpe.encode(hostile, MULTI, P.PATTERN).collect()) == expected


def test_bpe_hostile_and_empty(hostile, empty):
    assert bytebpe.encode(hostile, MULTI, P.PATTERN).count() == hostile.count()
    assert bytebpe.encode(empty, MULTI, P.PATTERN).count() == 0


# -- id files --------------------------------------------------------------


def test_value_code_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        values = rng.integers(0, 1 << 32, size=n, dtype=np.uint64).astype("<u4") >> rng.integers(0, 32, size=n).astype("<u4")
        control, data = idfiles.encode_values(values)
        assert len(control) == -(-n // 4) and idfiles.decode_values(control, data, n).tolist() == values.tolist()


def test_id_files_round_trip(spark, odd):
    path = idfiles.write(odd, scratch_path(spark, "t"), WORD_BPE, block_tokens=500)
    got, start = sorted(idfiles.read(spark, path).collect()), 0
    texts = texts_of(odd)
    assert [r.doc_id for r in got] == sorted(texts)
    for r in got:
        ids = library_ids(texts[r.doc_id])
        assert r.start == start and r.n_tokens == len(ids) and np.frombuffer(r.ids, dtype="<u4").tolist() == ids
        start += len(ids)
    crc = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in idfiles.digests(spark, path).collect()}
    assert crc == {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got}


def test_id_files_hostile_and_empty(spark, hostile, empty):
    assert idfiles.read(spark, idfiles.write(hostile, scratch_path(spark, "t"), WORD_BPE)).count() == hostile.count()
    assert idfiles.digests(spark, idfiles.write(empty, scratch_path(spark, "t"), WORD_BPE)).count() == 0




def test_coding_of_batches_equals_library_and_forgets_long_words(tmp_path):
    """Plain, marked and foreign texts in one batch, nulls and slices; a thousand words of 50 kB leave nothing behind."""
    import resource

    import pyarrow as pa

    from pitchlake.llm import tokens

    enc = tokens.ChunkEncoder(WORD_BPE, remembered=200)
    texts = ["", None, " \n\x0b", "Größe don't I'LL 12,5%", "é É\x85x y", "漢字 and ASCII", "ĀŸß l'eau ſs", "a" * 70 + " b", "'s's 'd", "\x00\x1c a"] * 3
    rng = random.Random(5)
    texts += [" ".join("".join(rng.choice("abÉß.,'9 \t字") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(60)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts) + 2)), "text": pa.array(["first", "second", *texts])}).slice(2)
    tokens._ENCODERS[WORD_BPE] = enc
    got = {i: ids.tolist() for i, ids in tokens.encoded([batch], WORD_BPE, 1)}
    expected = {i + 2: [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert got == expected
    single = {i: ids.tolist() for i, ids in _one_by_one(tokens, batch)}
    assert single == expected
    tokens._ENCODERS.clear()

    enc = tokens.ChunkEncoder(WORD_BPE)
    letters = [chr(97 + i % 26) for i in range(1000)]
    enc.encode("x" * 50_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for i, c in enumerate(letters):
        assert enc.encode(f"{c}{'字' if i % 2 else 'q'}" + "z" * 50_000 + str(i))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 40  # MB
    assert len(enc.pieces) + len(enc.others) < 200


def _one_by_one(tokens, batch):
    held, tokens.AT_ONCE = tokens.AT_ONCE, 1
    try:
        yield from tokens.encoded([batch], WORD_BPE, 1)
    finally:
        tokens.AT_ONCE = held
