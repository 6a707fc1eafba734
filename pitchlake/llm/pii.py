"""Personal data by weak supervision.

Candidates are the matches of fixed patterns (which always count as personal
data when they pass their checks) and looser ones: national telephone numbers,
spelled-out addresses, long IP addresses, card-like numbers that fail a check.
Labelers vote on every candidate or abstain: pattern, plausibility, two
gazetteers of nearby words (for and against) and the characters around it.
Looser candidates may overlap: each is judged, and of the accepted ones those
inside another are left out.
Expectation-maximisation over the counts of vote patterns, which Spark counts
over the whole corpus, estimates how reliable each labeler is; a logistic
classifier of span features is then trained on the resulting probabilities and
decides about the looser candidates. Vote and feature patterns are a closed set,
so what reaches the driver is bounded at any corpus size.

Null texts are empty and hold no spans. Repeated rows are judged each on its
own. Without candidates, the classifier accepts nothing beyond the fixed
patterns."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, id_text, rows, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: possessive forms of the fixed patterns; they match the same spans in linear time
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
}
#: words near a span that speak for its kind
FOR = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip host server address login from client dirección adresse".split()),
    "card": frozenset("card visa credit mastercard payment amex tarjeta carte karte".split()),
    "phone": frozenset("tel phone call fax mobile cell whatsapp teléfono téléphone telefon".split()),
}
#: words near a span that speak against personal data
AGAINST = frozenset("version v release section license isbn issn chapter figure fig order invoice page serial part no nr".split())
TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es uk us eu ch at it nl co".split())
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
NEAR = 40

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(spans that pass their check, those that fail), each by start and kind."""
    good: list[Span] = [(0, *s) for s in _emails(text)]
    bad: list[Span] = []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            (good if all(map(_small, m.groups())) else bad).append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                (good if 14 <= len(digits) <= 19 and luhn(digits) else bad).append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                n = sum(c.isdigit() for c in m.group())
                (good if 10 <= n <= 15 else bad).append((3, *m.span()))
    good.sort(key=lambda s: (s[1], s[0]))
    return good, bad


# -- labelers: 1 for personal data, 0 against, -1 abstains ------------------

VOTES = 5


def votes(text: str, span: Span, base: bool, failed: bool) -> tuple[int, ...]:
    kind, start, end = span
    name, found = KINDS[kind], text[start:end]
    before = {w.lower() for w in WORD.findall(text[max(0, start - NEAR) : start])}
    left, right = text[start - 1 : start], text[end : end + 1]
    if kind == 0:
        plausible = found.rstrip(")]}").rpartition(".")[2].strip().lower() in TOP_DOMAINS
    elif kind == 1:
        plausible = any(len(p) > 1 for p in re.split(r"[.:]", found))
    elif kind == 2:
        plausible = not failed and found[0] in "3456"
    else:
        digits = [c for c in found if c.isdigit()]
        plausible = 10 <= len(digits) <= 15 and len(set(digits)) > 2
    return (
        1 if base else 0 if failed else -1,
        int(plausible),
        1 if before & FOR[name] else -1,
        0 if before & AGAINST else -1,
        0 if (left.isalnum() or right.isalnum()) else 1,
    )


def pattern_of(kind: int, base: bool, vote: tuple[int, ...], found: str) -> int:
    """Kind, votes and form of a candidate as one number."""
    code = kind
    for v in vote:
        code = code * 3 + v + 1
    digits = sum(c.isdigit() for c in found)
    for flag in (base, digits * 2 > len(found), any(c in " -().[]" for c in found)):
        code = code * 2 + int(flag)
    return code


def unpacked(code: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    flags = []
    for _ in range(3):
        code, f = divmod(code, 2)
        flags.append(f)
    vote = []
    for _ in range(VOTES):
        code, v = divmod(code, 3)
        vote.append(v - 1)
    return code, tuple(reversed(vote)), tuple(reversed(flags))


def candidates(text: str) -> list[tuple[Span, bool, int]]:
    """(span, whether a fixed pattern, pattern number) by start and kind. Looser ones never overlap fixed ones, but may overlap each other."""
    good, bad = base_spans(text)
    loose: list[tuple[Span, bool]] = [(s, True) for s in bad]
    for kind, name in enumerate(KINDS):
        if name in LOOSE and (kind != 0 or "at" in text):
            loose += [((kind, *m.span()), False) for m in LOOSE[name].finditer(text)]
    out = [(s, True, pattern_of(s[0], True, votes(text, s, True, False), text[s[1] : s[2]])) for s in good]
    starts, ends = [], []  # of what the fixed ones cover
    for _, a, b in good:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for s, failed in loose:
        at = bisect_right(ends, s[1])
        if at == len(ends) or s[2] <= starts[at]:
            out.append((s, False, pattern_of(s[0], False, votes(text, s, False, failed), text[s[1] : s[2]])))
    return sorted(out, key=lambda c: (c[0][1], c[0][0]))


def settled(spans: list[Span]) -> list[Span]:
    """Accepted looser spans without those that lie within another one."""
    out, last = [], -1
    for s in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if s[2] > last:
            out.append(s)
            last = s[2]
    return out


# -- reliabilities and classifier ------------------------------------------


@dataclass(frozen=True)
class SpanModel:
    weights: np.ndarray
    reliability: np.ndarray  # class x labeler x (abstain, against, for)

    def accepts(self, code: int) -> bool:
        return bool(features([code])[0] @ self.weights > 0)


def features(codes) -> np.ndarray:
    """Span features: kind, votes (the pattern labeler's aside) and form, one-hot, and a constant."""
    rows = []
    for code in codes:
        kind, vote, flags = unpacked(int(code))
        row = [0.0] * (len(KINDS) + 3 * VOTES + 3)
        row[kind] = 1.0
        for j, v in enumerate(vote):
            row[len(KINDS) + 3 * j + v + 1] = 1.0
        row[-3:] = [float(flags[1]), float(flags[2]), 1.0]
        rows.append(row)
    return np.array(rows).reshape(-1, len(KINDS) + 3 * VOTES + 3)


def expectation_maximisation(vote: np.ndarray, kind: np.ndarray, n: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(probability of personal data for each vote pattern, reliabilities)."""
    one_hot = (vote[:, :, None] + 1 == np.arange(3)).astype(float)
    p = (1.0 + (vote == 1).sum(axis=1)) / (2.0 + (vote >= 0).sum(axis=1))  # starts from the majority
    for _ in range(steps):
        weight = np.stack([(1 - p) * n, p * n])  # class x pattern
        # pseudo-counts say that a labeler is rather right than wrong
        trust = np.array([[2.0, 4.0, 1.0], [2.0, 1.0, 4.0]])
        table = np.einsum("cp,plv->clv", weight, one_hot) + trust[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->pc", one_hot, np.log(table))
        for k in range(len(KINDS)):
            own = kind == k
            prior = (weight[1, own].sum() + 1) / (weight[:, own].sum() + 2)
            logs[own] += np.log([1 - prior, prior])
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return p, table


def train(counts: list[tuple[int, int]], steps: int = 200, l2: float = 1.0) -> SpanModel:
    """From (pattern number, count)."""
    if not counts:
        weights = np.zeros(len(KINDS) + 3 * VOTES + 3)
        weights[-1] = -1.0
        return SpanModel(weights, np.full((2, VOTES, 3), 1 / 3))
    codes, n = np.array(sorted(counts), dtype=float).T
    split = [unpacked(int(c)) for c in codes]
    p, table = expectation_maximisation(np.array([v for _, v, _ in split]), np.array([k for k, _, _ in split]), n)
    x, w = features(codes), np.zeros(len(KINDS) + 3 * VOTES + 3)
    for _ in range(steps):  # Newton steps of the weighted logistic loss
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (q - p)) + l2 * w
        hessian = (x * (n * q * (1 - q))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(w, table)


FOUND_DDL = "doc_id long, spans binary"


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its candidates as int64 rows (kind, start, end, fixed, pattern)."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.binary())])

    def run(batches):
        def out():
            for d, t in rows(batches, "doc_id", "text"):
                yield d, np.array([(*s, int(base), code) for s, base, code in candidates(t)], dtype="<i8").tobytes()

        yield from batched(out(), schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, FOUND_DDL)


def _table(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<i8").reshape(-1, 5)


def _trained(source: DataFrame, column: str, codes_of) -> SpanModel:
    """Train on how often each pattern is met; the driver gets a row per pattern."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def count(batches):
        met = Counter(code for (value,) in rows(batches, column) for code in codes_of(value))
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int64()), pa.array(list(met.values()), pa.int64())], schema=schema)

    counts = source.select(column).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return train([(r.code, r.n) for r in counts.collect()])


def fit(candidates_of: DataFrame) -> SpanModel:
    """Train on the candidates that :func:`found` lists."""
    return _trained(candidates_of, "spans", lambda blob: _table(blob)[:, 4].tolist())


def fit_texts(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Train on the candidates of all texts, without listing them."""
    return _trained(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", lambda text: [code for _, _, code in candidates(text)])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def report(candidates_of: DataFrame, model: SpanModel) -> DataFrame:
    """Counts and hash of the fixed patterns' spans, and all accepted spans, per document."""
    schema = pa.schema([
        ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()),
    ])

    def run(batches):
        known: dict[int, bool] = {}

        def accepted(code: int) -> bool:
            if code not in known:
                known[code] = model.accepts(code)
            return known[code]

        def out():
            for b in batches:
                for d, blob in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist()):
                    table = _table(blob).tolist()
                    base = [(k, s, e) for k, s, e, fixed, _ in table if fixed]
                    every = sorted(base + settled([(k, s, e) for k, s, e, fixed, code in table if not fixed and accepted(code)]), key=lambda s: (s[1], s[0]))
                    n = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                    yield d, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base)

        yield from batched(out(), schema)

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return candidates_of.mapInArrow(run, ddl)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find candidates once, train on all of them, report."""
    candidates_of = written(found(docs, id_col, text_col), "pii")
    return report(candidates_of, fit(candidates_of))


def redacted_text(text: str, model: SpanModel) -> str:
    """The text with every accepted span replaced by its kind; spans that overlap become one."""
    out, at, last = [], 0, -1
    for (kind, start, end), fixed, code in candidates(text):
        if not (fixed or model.accepts(code)):
            continue
        if start >= last:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
        at = last
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data in ``text_col`` replaced; nulls stay null, other columns stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            new = [None if t is None else redacted_text(t, model) for (t,) in rows([b], text_col)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, type=b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
