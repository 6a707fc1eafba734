"""Language identification by Bayesian evidence fusion.

A page's text, the language its markup declares, the suffix of its address and
its host speak for its language. The text likelihood comes from hashed character
trigrams, counted per language over all labelled documents; it is tempered, since
neighbouring trigrams are not independent. Text alone gives a first posterior;
grouped sums of it give the priors: each host's leans on its address suffix, the
suffix's on the whole corpus, each by a Dirichlet weight, and a page's own share
is taken out of all three. The reliability of a declaration is the distribution
of declared languages within each language, smoothed. The product of all decides.

Null or empty pages are decided by the priors; null addresses are one host of
their own and so are addresses without a host. Repeated rows are judged each on
its own. Ties go to the first language by name. Without labelled documents there
is no language, and the result is null. An empty table gives an empty result."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, rows, written

BUCKETS = 1 << 15
#: trigrams that a text counts as at most
TEMPERED = 60.0
#: weight of the suffix's distribution in a host's, and of the corpus's in a suffix's
LEANING = 5.0
DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def buckets(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text; white space and digits are blanks."""
    raw = np.frombuffer((" " + re.sub(r"[\s\d]+", " ", text.lower()) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    log: np.ndarray  # languages x buckets

    def scores(self, text: str) -> list[float]:
        at = buckets(text)
        if not len(at):
            return [0.0] * len(self.languages)
        return (self.log[:, at].mean(axis=1) * min(len(at), TEMPERED)).tolist()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Counts trigrams over all labelled documents; a row per language and bucket reaches the driver."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    source = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for lang, text in rows(batches, "lang", "text"):
            total[lang] = total.get(lang, 0) + np.bincount(buckets(text), minlength=BUCKETS)
        yield from batched(((lang, int(b), int(n[b])) for lang, n in total.items() for b in np.flatnonzero(n)), schema)

    counts = source.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in counts})
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in counts:
        table[languages.index(r.lang), r.bucket] += r.n
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)) if languages else table)


def evidence(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, suffix, declared and the text's score for each language."""
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("url", "host", "suffix", "declared")), ("scores", pa.list_(pa.float64()))])
    names = {"page_id": (id_col, "long"), "url": (url_col, "string"), "html": (html_col, "string")}

    def run(batches):
        def out():
            for page_id, url, page in rows(batches, "page_id", "url", "html"):
                found = HOST.match(url or "")
                host = found[1].lower() if found else ""
                declared = DECLARED.search(page or "")
                text = html.unescape(DROPPED.sub(" ", page or ""))
                yield page_id, url, host, host.rpartition(".")[2], declared[1].lower() if declared else "", model.scores(text)

        yield from batched(out(), schema)

    source = pages.select(*[F.col(c).cast(t).alias(n) for n, (c, t) in names.items()])
    return source.mapInArrow(run, "page_id long, url string, host string, suffix string, declared string, scores array<double>")


def _each(n: int, make) -> Column:
    return F.array(*[make(i) for i in range(n)])


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, lang, its posterior, the language by text alone, and the declared one."""
    n = len(model.languages)
    seen = evidence(pages, model, id_col, url_col, html_col)
    if not n:
        none = F.lit(None).cast("string")
        return seen.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("posterior"), none.alias("text_lang"), "declared")

    def normal(scores: Column) -> Column:
        top = F.array_max(scores)
        raised = F.transform(scores, lambda x: F.exp(x - top))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))

    seen = written(seen.withColumn("first", normal(F.col("scores"))), "langid")
    sums = lambda *by: seen.groupBy(*by).agg(*[F.sum(F.col("first")[i]).alias(f"{(by or ('all',))[0]}{i}") for i in range(n)])
    whole = sums().first()
    total = [float(x or 0.0) for x in whole]
    # a join for each level: neither hosts nor suffixes nor declarations have a known bound
    # (written first, so that a hot one is split by Spark's skew join)
    rows_ = seen
    for level in ("host", "suffix", "declared"):
        rows_ = rows_.join(written(sums(level), "langid"), level)
    own = lambda level, i: F.greatest(F.col(f"{level}{i}") - F.col("first")[i], F.lit(0.0))
    size = lambda level: sum((own(level, i) for i in range(n)), F.lit(0.0))
    corpus = [(F.greatest(F.lit(total[i]) - F.col("first")[i], F.lit(0.0)) + 1.0) / (F.lit(sum(total)) - 1.0 + n) for i in range(n)]
    suffix = [(own("suffix", i) + LEANING * corpus[i]) / (size("suffix") + LEANING) for i in range(n)]
    rows_ = rows_.withColumn("suffix_prior", F.array(*suffix))
    host = [(own("host", i) + LEANING * F.col("suffix_prior")[i]) / (size("host") + LEANING) for i in range(n)]
    said = [F.when(F.col("declared") == "", 0.0).otherwise(F.log((own("declared", i) + 0.1) / (F.lit(total[i]) + 1.0))) for i in range(n)]
    fused = rows_.withColumn("fused", _each(n, lambda i: F.col("scores")[i] + F.log(host[i]) + said[i]))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return fused.select("page_id", "url", best(F.col("fused")).alias("lang"), F.array_max(normal(F.col("fused"))).alias("posterior"), best(F.col("scores")).alias("text_lang"), "declared")
