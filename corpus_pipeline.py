"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each one of the operators of ``pitchlake.llm`` at work on all that
the stage before it kept. A stage's result is written as Parquet and read again
as the next one's input, so a lost executor costs its tasks and no more, and no
lineage runs across stages. The tables go to the folder that
``spark.checkpoint.dir`` names.

1. ``quality_rules``: documents that the base rules or the line labels reject go.
2. ``near_dedup``: of each group of near copies the smallest id stays.
3. ``suffix_dedup``: byte strings of 100 that start earlier too are cut out.
4. ``pii``: personal data becomes its kind in brackets.
5. ``packing``: pieces of at most 2048 token ids in sequences.

All but the last return the columns of ``documents``; where a stage changes the
text, ``n_chars`` follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import minhash, packing, pii, quality, repeats
from pitchlake.llm.common import written

TOKENIZER = "word_bpe_49k.json"


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, in its type."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of content; the line field is fitted to labelled ones among ``docs``."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(repeats.without_repeats(docs, length=100))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The span classifier is trained on the candidates of all ``docs``."""
    return _counted(pii.redact(docs, pii.fit_texts(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("pii", personal_data),
    ("packing", pack),
]

#: trained verdicts, set links and suffix order have no SQL; tests/llm/test_pipeline.py checks run() by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
