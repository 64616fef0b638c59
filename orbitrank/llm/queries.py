"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orbitrank.llm import (
    alignment, byte_pairs, chat, fill_middle, fingerprints, hidden_markov, jaccard, language, main_text, mixing,
    piece_counts, simhash, top_k,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_chat_formatting", chat.PERSPECTIVES_SQL)
def op1(spark, sf_dir):
    seen = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    return seen.withColumn("spans", chat.spans_text(seen["spans"]))


@_query("op5_source_mixing", mixing.REPORT_SQL)
def op5(spark, sf_dir):
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


@_query("op10_token_counts")
def op10(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_counts.count_tokens(_table(spark, sf_dir, "documents"), path)


@_query("op2_language_id")
def op2(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held_out = language.held_out(docs["doc_id"], 5)
    predicted = language.predict(docs, language.learn(docs.where(~held_out)))
    return predicted.select(
        "doc_id", language.held_out(predicted["doc_id"], 5).alias("held_out"), "lang_pred", "score",
        "bits", "n_symbols", "rejected",
    )


@_query("op7_bpe_roundtrip")
def op7(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return byte_pairs.digests(byte_pairs.encode_decode(_table(spark, sf_dir, "documents"), path))


@_query("op3_html_main_text")
def op3(spark, sf_dir):
    return main_text.extract(_table(spark, sf_dir, "pages"))


@_query("op8_fingerprints")
def op8(spark, sf_dir):
    return fingerprints.fingerprint_corpus(_table(spark, sf_dir, "documents"))


#: Links of the registered join: three-word shingles, nine tenths of the union.
NEAR_COPIES = jaccard.Likeness(words=3, per_cent=90)


@_query("op9_jaccard_join")
def op9(spark, sf_dir):
    return jaccard.linked_documents(_table(spark, sf_dir, "documents"), NEAR_COPIES)


@_query("op4_lm_scoring")
def op4(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scored = hidden_markov.score_corpus(docs, ~language.held_out(docs["doc_id"], 10))
    return scored.select(
        "doc_id", language.held_out(scored["doc_id"], 10).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score",
    )


@_query("op6_exact_top_k", top_k.TOP_K_SQL)
def op6(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return top_k.top_k(docs, docs["doc_id"] % 20 == 0)


@_query("op12_fill_in_middle", fill_middle.FILL_SQL)
def op12(spark, sf_dir):
    return fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))


@_query("op11_simhash")
def op11(spark, sf_dir):
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


@_query("op13_tokenizer_alignment")
def op13(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_corpus(_table(spark, sf_dir, "documents"), *paths)
