"""Registered queries of the text operators: thin digests over their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, chat, filter_audit, html, idfiles, langid, merkle, minhash, packing, pii, quality, repeats, variants
from .common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=100)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    path = _tokenizer("byte_bpe_multi_50k.tiktoken")
    coded = bytebpe.decode(bytebpe.encode(_table(spark, sf_dir, "documents"), path, PATTERN), path, PATTERN)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "pages"), langid.fit(_table(spark, sf_dir, "documents")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idfiles.write(_table(spark, sf_dir, "documents"), scratch_path(spark, "idfiles"), _tokenizer("word_bpe_49k.json"))
    return idfiles.digests(spark, path)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(_table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_planted(_table(spark, sf_dir, "conversations"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_suffix_dedup, op3_packing, op4_html_extraction, op5_fingerprints,
        op6_byte_bpe, op7_language_id, op8_minhash_near_dedup, op9_token_files, op10_pii,
        op11_spelling_variants, op12_chat_format, op13_filter_audit,
    )
}
#: Fingerprints are hashes and sets, which SQL has. Phrases are cut at a mark that replaces the blanks where one ends,
#: since DuckDB's patterns do not look behind.
FINGERPRINTS_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n_chars, length(text) // 2 AS half,
        COALESCE(LEAD(text) OVER (ORDER BY doc_id DESC), FIRST_VALUE(text) OVER (ORDER BY doc_id DESC)) AS after FROM d),
e AS (SELECT doc_id, n_chars, text AS a, substring(text, 1, n_chars - half) || substring(after, 1, half) AS b, after AS c FROM o),
t AS (SELECT doc_id, n_chars, b, UNNEST([{'k': 'a', 'x': a}, {'k': 'b', 'x': b}, {'k': 'c', 'x': c}], recursive := true) FROM e),
h AS (SELECT doc_id, n_chars, b, k, list_transform(string_split(x, chr(10)), lambda p: sha256(p)) AS paragraphs,
        list_distinct(string_split(replace(regexp_replace(x, '([.,;:!?dglnz])[ \t]+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))) AS phrases FROM t),
m AS (SELECT *, array_to_string(list_transform(paragraphs, lambda q: CASE WHEN q[1] IN ('0', '1', '2', '3') OR q = sha256('') THEN q || '|' ELSE q END), '') AS marked FROM h),
r AS (SELECT *, sha256(array_to_string(list_transform(string_split(regexp_replace(marked, '\|$', ''), '|'), lambda z: sha256(z)), '')) AS root FROM m),
s AS (SELECT x.doc_id, x.n_chars, x.b, x.root AS ra, y.root AS rb, z.root AS rc, x.phrases AS pa, y.phrases AS pb, z.phrases AS pc, x.paragraphs AS qa, y.paragraphs AS qb
      FROM r x JOIN r y ON x.doc_id = y.doc_id AND y.k = 'b' JOIN r z ON x.doc_id = z.doc_id AND z.k = 'c' WHERE x.k = 'a')
SELECT doc_id, n_chars, sha256(b) AS edited_sha256, ra AS fingerprint, rb AS edited_fingerprint,
  CASE WHEN ra = rb THEN 1E0 ELSE 2E0 * len(list_intersect(pa, pb)) / (len(pa) + len(pb)) END AS near_edited,
  CASE WHEN ra = rc THEN 1E0 ELSE 2E0 * len(list_intersect(pa, pc)) / (len(pa) + len(pc)) END AS near_next,
  CAST(CASE WHEN ra = rb THEN 0 ELSE len(list_filter(qa, lambda q: NOT list_contains(qb, q))) END AS INT) AS n_changed_paragraphs
FROM s
"""

#: Links by all pairs that share a shingle, components by what can be reached.
LINKS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM t),
u AS (SELECT doc_id, UNNEST(shingles) AS x FROM t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other),
c AS (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.doc_id = n.doc_id
"""

#: Turns in order, their roles compared with the turn before; the length of the formatted text from its parts.
CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, md5(text) AS digest, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS escaped,
        LAG(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS before FROM t)
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, digest)) AS turns_sha256,
  CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, digest)) AS loss_sha256,
  CAST(SUM(length(escaped) + CASE WHEN before = role THEN length('<|im_sep|>') ELSE length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

#: Each order and step over the counts of the patterns that occur in a part.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, MIN(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, MAX(CAST(quality = 1 AS INT)) AS good, MAX(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM p, (SELECT UNNEST([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own, contains(fails, own) AS hit, before <> '' AND translate(fails, before, '') <> fails AS gone, fails = own AS alone, n, good, toxic FROM c, s),
a AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
    SUM(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, SUM(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    SUM(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, SUM(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    SUM(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, SUM(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM a
"""

#: a trained verdict, suffix order, packing, tag paths, BPE merges and check sums have no SQL; tests/llm holds them
#: against brute force, exact round trips and held-out labels instead
ORACLE: dict[str, str] = {
    "op5_fingerprints": FINGERPRINTS_SQL, "op8_minhash_near_dedup": LINKS_SQL,
    "op12_chat_format": CHAT_SQL, "op13_filter_audit": AUDIT_SQL,
}
