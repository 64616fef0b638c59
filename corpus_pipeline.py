"""The corpus pipeline: identify languages, drop near copies, mix sources, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orbitrank.llm import byte_pairs, jaccard, language, mixing
from orbitrank.session import scratch_path, ship_package

#: Near copies share four fifths of their five-word shingles.
NEAR_COPIES = jaccard.Likeness(words=5, per_cent=80)
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Rows that a Python worker gets at once: texts are long, and the buffers behind a batch stay.
ARROW_ROWS = 500

#: No SQL: character models, and merges that depend on each other, are beyond it.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    """Send the package to the workers and keep the session's batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the rejected ones go."""
    _ready(spark)
    return language.drop_rejected(docs, language.learn(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    _ready(spark)
    return jaccard.one_of_each(docs, NEAR_COPIES)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the tokens and of what they decode to."""
    _ready(spark)
    return byte_pairs.digests(byte_pairs.encode_decode(docs, TOKENIZER))


STAGES = [
    ("language_id", known_languages),
    ("near_copies", without_copies),
    ("source_mix", mixed_sources),
    ("encode", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
