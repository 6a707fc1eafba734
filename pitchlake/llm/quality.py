"""Quality rules by line labelling.

A linear-chain conditional random field labels every line of a text as content
or boilerplate. Its features are binned measures of the line (length, symbols,
capitals, repeats and so on); its weights are fitted to the lines of a bounded
sample of labelled documents, whose document label stands for all their lines.
Viterbi decoding gives the best labelling of a whole text; the share of its
words in content lines decides whether the document is kept. Simple base rules
(too few words, too many repeated words) reject on their own.

Null and empty texts have no words and fail the base rules. Repeated rows are
judged each on its own; the fit takes one text of an id (the least) and one label (the
least), so repeats do not widen its bound. Null ids are judged, and never fitted to.
Columns other than id and text are not read, so their names cannot clash. Without
labelled rows all weights are zero; ties go to content. An empty table gives an
empty result."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, id_text, rows

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS_LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
SPACE = b" \t\n\x0b\x0c\r"

#: upper edges of the bins of each measure
EDGES = (
    (1, 4, 9, 19, 49, 199),  # words
    (0.0, 0.05, 0.15, 0.3, 0.6),  # ASCII characters that are no letter, digit or space, per byte
    (0.0, 0.05, 0.2, 0.5, 0.8),  # ASCII capitals per ASCII letter
    (2.0, 3.0, 5.0, 7.0, 10.0),  # bytes per word
    (0.1, 0.3, 0.5, 0.7, 0.9),  # distinct words per word
    (0.0, 0.05, 0.2, 0.5),  # digits per byte
    (0.0, 0.02, 0.1, 0.3),  # ! and ? per word
    (0.0, 0.1, 0.3, 0.6),  # words equal to the word before
    (0.0, 0.1, 0.3, 0.6),  # the document's words in repeated windows
    (0.5,),  # equal to an earlier line
    (0.5,),  # ends like a sentence
)
BASE = np.cumsum([0] + [len(e) + 1 for e in EDGES])
N_FEATURES = int(BASE[-1])


@dataclass(frozen=True)
class LineField:
    """Weights of the field; label 1 is content."""

    emit: np.ndarray  # features x 2
    move: np.ndarray  # 2 x 2, from and to
    first: np.ndarray  # 2

    @staticmethod
    def blank() -> "LineField":
        return LineField(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))


@dataclass
class Measured:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    words: np.ndarray  # of each line with a word
    features: np.ndarray  # lines with a word x measures: the feature numbers


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(windows)] |= hit
    return int(covered.sum())


def measure(text: str) -> Measured:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    repeats = repeated_words(words)
    seen: set[bytes] = set()
    dup_lines, sizes, rows = 0, [], []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        dup = line in seen
        seen.add(line)
        dup_lines += dup
        k, size = len(own), len(line)
        upper = size - len(line.translate(None, UPPER))
        lower = size - len(line.translate(None, LETTERS_LOWER))
        digits = size - len(line.translate(None, DIGITS))
        blank = size - len(line.translate(None, SPACE))
        high = sum(len(w) for w in own)
        other = len(line.translate(None, ODD_KEEP))
        sizes.append(k)
        rows.append((
            k, other / size, upper / (upper + lower or 1), (size - blank) / k, len(set(own)) / k, digits / size,
            (line.count(b"!") + line.count(b"?")) / k, sum(map(bytes.__eq__, own, own[1:])) / k if high else 0.0,
            repeats / n, float(dup), float(own[-1][-1:] in b".!?:"),
        ))
    table = np.array(rows, dtype=float).reshape(-1, len(EDGES))
    features = np.stack([BASE[j] + np.searchsorted(e, table[:, j]) for j, e in enumerate(EDGES)], axis=1)
    return Measured(n, len(text) - spaces, len(raw.translate(None, NOT_SYMBOL)), dup_lines, repeats, np.array(sizes, dtype=np.int64), features)


#: letters, digits, spaces and all bytes beyond ASCII
ODD_KEEP = UPPER + LETTERS_LOWER + DIGITS + SPACE + bytes(range(128, 256))


def viterbi(field: LineField, features: np.ndarray) -> np.ndarray:
    """The best labels (1: content) of a sequence of lines."""
    scores = field.emit[features].sum(axis=1)
    n = len(scores)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    m00, m01, m10, m11 = field.move.ravel().tolist()
    s0, s1 = (field.first + scores[0]).tolist()
    came = []
    for e0, e1 in scores[1:].tolist():
        a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
        came.append((1 if b >= a else 0, 1 if d >= c else 0))
        s0, s1 = max(a, b) + e0, max(c, d) + e1
    labels = np.empty(n, dtype=np.int64)
    labels[-1] = now = 1 if s1 >= s0 else 0
    for i in range(n - 2, -1, -1):
        labels[i] = now = came[i][now]
    return labels


def train(sequences: list[tuple[np.ndarray, int]], longest: int = 32, steps: int = 150, rate: float = 0.3, l2: float = 1e-4) -> LineField:
    """Maximum likelihood by gradient ascent. A sequence is (features, label of all its lines); long ones are cut into parts."""
    parts = [(f[lo : lo + longest], y) for f, y in sequences for lo in range(0, len(f), longest)]
    if not parts:
        return LineField.blank()
    n, t = len(parts), max(len(f) for f, _ in parts)
    x = np.zeros((n, t, len(EDGES)), dtype=np.int64)
    on = np.zeros((n, t), dtype=bool)
    for i, (f, _) in enumerate(parts):
        x[i, : len(f)], on[i, : len(f)] = f, True
    y = np.array([label for _, label in parts])
    want = np.zeros((n, t, 2))
    want[np.arange(n), :, y] = on
    weight = on[:, :, None] / on.sum()  # of each line
    emit, move, first = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move, first)]
    pairs = np.zeros((n, 2, 2))
    pairs[np.arange(n), y, y] = np.maximum(on.sum(axis=1) - 1, 0)
    for step in range(1, steps + 1):
        score = emit[x].sum(axis=2)
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = first + score[:, 0]
        for k in range(1, t):
            new = np.logaddexp(forward[:, k - 1, 0, None] + move[0], forward[:, k - 1, 1, None] + move[1]) + score[:, k]
            forward[:, k] = np.where(on[:, k, None], new, forward[:, k - 1])
        for k in range(t - 2, -1, -1):
            ahead = backward[:, k + 1] + score[:, k + 1]
            new = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
            backward[:, k] = np.where(on[:, k + 1, None], new, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        prob = np.exp(forward + backward - total[:, None, None]) * on[:, :, None]
        both = forward[:, :-1, :, None] + move + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.where(on[:, 1:, None, None], both, -np.inf))).sum(axis=(0, 1))
        change = (want - prob) * weight
        g_emit = np.zeros_like(emit)
        for j in range(len(EDGES)):
            for label in (0, 1):
                g_emit[:, label] += np.bincount(x[:, :, j].ravel(), change[:, :, label].ravel(), N_FEATURES)
        grads = (g_emit - l2 * emit, (pairs.sum(axis=0) - expected) / on.sum() - l2 * move, (want - prob)[:, 0].sum(axis=0) / n - l2 * first)
        for p, g, (m, v) in zip((emit, move, first), grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineField(emit, move, first)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """Fit the field to at most ``max_labelled`` labelled documents, chosen by a hash of their id.

    Only the feature numbers of their lines reach the driver."""
    picked = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.binary())])

    def lines(batches):
        def out():
            for d, y, t in rows(batches, "doc_id", "label", "text"):
                yield d, y, measure(t).features.astype(np.uint8).tobytes()

        yield from batched(out(), schema)

    held = id_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")  # at most max_labelled rows
    held = held.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # and now at most one text for each
    got = sorted((r.doc_id, r.label, bytes(r.features)) for r in held.mapInArrow(lines, "doc_id long, label int, features binary").collect())
    return train([(np.frombuffer(f, dtype=np.uint8).reshape(-1, len(EDGES)), int(y > 0)) for _, y, f in got])


@dataclass(frozen=True)
class Verdict:
    measured: Measured
    base_failed: bool
    content_words: int
    kept: bool


def judge(text: str | None, field: LineField, min_words: int, max_repeat_percent: int, min_content: float) -> Verdict:
    m = measure(text or "")
    failed = m.n_words < min_words or 100 * m.n_repeat_words > max_repeat_percent * m.n_words
    content = int(m.words[viterbi(field, m.features) == 1].sum())
    return Verdict(m, failed, content, not failed and content >= min_content * m.n_words)


def judged(docs: DataFrame, field: LineField, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base measures, words in content lines and the verdict."""
    schema = pa.schema([
        ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()), ("n_content_words", pa.int64()), ("kept", pa.bool_()),
    ])

    def run(batches):
        def out():
            for d, t in rows(batches, "doc_id", "text"):
                v = judge(t, field, min_words, max_repeat_percent, min_content)
                m = v.measured
                yield d, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, v.base_failed, v.content_words, v.kept

        yield from batched(out(), schema)

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_content_words long, kept boolean"
    return id_text(docs, id_col, text_col).mapInArrow(run, ddl)


def keep(docs: DataFrame, field: LineField, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    name = text_col

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([judge(t, field, min_words, max_repeat_percent, min_content).kept for (t,) in rows([b], name)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
