"""Every operator on nulls, empty and very long texts, ties, repeated rows, no rows, and clashing columns."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from orbitrank.llm import (
    byte_pairs, chat, fingerprints, hidden_markov, jaccard, language, main_text, mixing, piece_counts, top_k,
)

LONG = "lang wort " * 60_000
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, "
    "`set` string, class string, row string, rank string, target string, held_out string"
)
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 8) for r in rows], SCHEMA)


MESSY = [
    (1, "the cat sat on the mat and the dog", "en", "a"), (1, "the cat sat on the mat and the dog", "en", "a"),
    (2, None, "en", "a"), (3, "", "de", "b"), (4, " \n\t ", "de", None), (5, "!!! 12 ...", None, None),
    (None, "der hund und die katze im haus", "de", "b"), (None, "der hund und die katze im haus", "de", "b"),
    (6, LONG, "de", "c"), (7, "x", None, "c"), (8, "😀 \x00 ﬁ ÉÇ <|endoftext|> ▁", "en", "a"),
    (20, "the cat sat on the mat and the dog", "en", "b"), (40, "cat", "en", "b"), (9, "a" * 70_000, "en", "c"),
]
LIKE = jaccard.Likeness(words=3, per_cent=90)


@pytest.fixture(scope="module")
def messy(spark):
    return _docs(spark, MESSY)


@pytest.fixture(scope="module")
def nothing(spark):
    return _docs(spark, [])


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, part string, speaker string, offset string"
    rows = [
        (1, 0, "system", "be kind", *"xxx"), (1, 1, "ann", "hi", *"xxx"), (1, 2, None, None, *"xxx"),
        (1, None, "bob", "late", *"xxx"), (1, 1, "ann", "hi", *"xxx"), (None, 0, "ann", LONG, *"xxx"),
        (2, 0, "system", "alone", *"xxx"),
    ]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, schema)).collect()
    by = {(r["conv_id"], r["speaker"], r["part"] > 0): r for r in got}
    assert {(c, s) for c, s, _ in by} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = by[1, "ann", False]
    assert [ann["text"][s["begin"]:s["end"]] for s in ann["spans"]] == ["hi<|end|>"] * 2
    assert ann["text"].startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n")
    assert by[1, "bob", True]["offset"] == len(by[1, "bob", False]["text"])
    assert by[1, "bob", True]["text"] == "<|assistant|>\nlate<|end|>\n"
    assert by[None, "ann", False]["n_turns"] == 1
    assert chat.rotate_perspectives(spark.createDataFrame([], schema)).count() == 0


def test_language(messy, nothing):
    got = language.predict(messy, language.learn(messy, sample_docs=100)).collect()
    assert len(got) == len(MESSY)
    blank = {2, 3, 4, 5}
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in blank) == (r["n_symbols"] == 0)
        assert 0 <= r["score"] <= 1 and (r["score"] == 0) == (r["doc_id"] in blank)
    assert language.learn(nothing) is None
    assert language.predict(nothing, None).count() == 0
    assert {r["lang_pred"] for r in language.predict(messy, None).collect()} == {"und"}
    model = language.learn(messy, sample_docs=100)
    kept = language.drop_rejected(messy, model)
    assert kept.columns == messy.columns
    assert not blank & {r["doc_id"] for r in kept.collect()}
    assert kept.count() == language.drop_rejected(messy, None).count() == len(MESSY) - len(blank)


def test_main_text(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [
        (1, "u", None, *"xx"), (1, "u", None, *"xx"), (2, None, "", *"xx"), (None, "v", "<p>a &lt; b", *"xx"),
        (3, "w", "<div>" * 5_000 + "deep" + "</p>" * 9, *"xx"), (4, "w", "<article>" + "<p>x, y</p>" * 20_000, *"xx"),
    ]
    got = main_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got)[:5] == [
        (0, "a < b"), (1, ""), (1, ""), (2, ""), (3, "deep")
    ]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == 20_000 * 5 - 1
    assert main_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_language_model(messy, nothing):
    got = hidden_markov.score_corpus(messy, messy["doc_id"].isNotNull()).collect()
    assert len(got) == len(MESSY)
    tokens = {r["doc_id"]: r["n_tokens"] for r in got}
    assert (tokens[2], tokens[3], tokens[4], tokens[6], tokens[1]) == (1, 1, 1, 120_001, 10)
    assert all(r["base_score"] < 0 and r["score"] < 0 for r in got)
    unseen = [r for r in got if r["doc_id"] is None]
    assert [r["n_known"] for r in unseen] == [1, 1]
    same = [(r["base_score"], r["score"]) for r in got if r["doc_id"] in (1, 20)]
    assert len(set(same)) == 1
    assert hidden_markov.score_corpus(nothing, nothing["doc_id"].isNotNull()).count() == 0
    untaught = hidden_markov.score_corpus(messy, messy["doc_id"] < 0).collect()
    assert {r["n_known"] for r in untaught} == {0} and {r["train_tokens"] for r in untaught} == {0}


def test_mixing(messy, nothing):
    got = mixing.mix_report(messy).collect()
    assert len(got) == len(MESSY)
    assert all(r["taken"] in {r["size"] * i for i in range(4)} for r in got)
    sizes = {r["doc_id"]: r["size"] for r in got}
    assert (sizes[2], sizes[3], sizes[4], sizes[1], sizes[6]) == (0, 0, 0, 9, 120_000)
    assert sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    assert got[0]["source_size"] > 0
    assert mixing.mix_report(nothing).count() == 0
    mixed = mixing.mix_documents(messy)
    assert mixed.columns == messy.columns
    assert mixed.count() == sum(r["repeats"] for r in got)
    assert mixing.mix_documents(nothing).count() == 0


def test_top_k(messy, nothing):
    got = top_k.top_k(messy, messy["doc_id"] % 20 == 0, k=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["doc_id"])
    assert by == {20: [1, 1, 20], 40: [40, 1, 1]}
    assert top_k.top_k(nothing, nothing["doc_id"] % 20 == 0).count() == 0
    assert top_k.top_k(messy, messy["doc_id"] < 0).count() == 0


def test_byte_pairs(messy, nothing):
    got = byte_pairs.digests(byte_pairs.encode_decode(messy, WORD_BPE)).collect()
    assert len(got) == len(MESSY)
    counts = {r["doc_id"]: r["n_tokens"] for r in got}
    assert counts[2] == counts[3] == counts[4] == 0 and counts[6] > 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["decoded_sha256"] for r in got if r["n_tokens"] == 0} == {empty}
    assert byte_pairs.digests(byte_pairs.encode_decode(nothing, WORD_BPE)).count() == 0


def test_fingerprints(messy, nothing):
    got = fingerprints.fingerprint_corpus(messy).collect()
    assert len(got) == len(MESSY)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == "" and by[2]["n_chars"] == 0
    assert by[1]["fingerprint"] == by[20]["fingerprint"] != ""
    assert by[3]["near_next"] == 1.0 and by[4]["near_next"] == 0.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    # After the rows without id comes the first, the one with the highest id.
    cat = [r for r in got if r["doc_id"] is None]
    texts = {r[0]: r[1] for r in MESSY}
    half = fingerprints.edited(texts[None], texts[40])
    assert hashlib.sha256(half.encode()).hexdigest() in {r["edited_sha256"] for r in cat}
    assert fingerprints.fingerprint_corpus(nothing).count() == 0


def test_jaccard(messy, nothing):
    got = jaccard.linked_documents(messy, LIKE).collect()
    assert len(got) == len(MESSY)
    by = {r["doc_id"]: r for r in got}
    assert by[20]["component_id"] == 1 and by[20]["n_links"] == 2
    assert by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[2]["n_links"] == 0
    assert by[40]["n_shingles"] == 1 and by[6]["n_shingles"] == 2
    assert by[None]["component_id"] is None
    kept = jaccard.one_of_each(messy, LIKE)
    assert kept.columns == messy.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    assert ids == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 40]
    assert jaccard.linked_documents(nothing, LIKE).count() == 0
    assert jaccard.one_of_each(nothing, LIKE).count() == 0


def test_token_counts(messy, nothing):
    got = {r["doc_id"]: r for r in piece_counts.count_tokens(messy, PIECES).collect()}
    assert (got[2]["n_tokens"], got[3]["n_tokens"], got[2]["n_bytes"]) == (0, 0, 0)
    assert got[6]["over_limit"] and not got[1]["over_limit"] and got[6]["n_bytes"] == len(LONG)
    assert piece_counts.count_tokens(messy, PIECES).count() == len(MESSY)
    assert piece_counts.count_tokens(nothing, PIECES).count() == 0


def test_pipeline_stages(spark, messy, nothing, tmp_path):
    for name, table in (("messy", messy), ("nothing", nothing)):
        docs = table
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}-{step}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{step}")
            if step != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == table.columns
        assert (docs.count() > 0) == (name == "messy")


def test_working_names_are_free(spark):
    """Columns called like working ones come out as they went in."""
    names = ("row", "outcome", "turn", "size", "key", "hash", "id", "stays", "text_hash", "__text", "__key", "__size",
             "__turn", "__mix", "__OUTCOME", "class", "first", "set")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{x}` string" for x in names)
    rows = [(i, f"the cat sat on the mat {i % 5}", "en", "ab"[i % 2], 1, *(f"{x}{i}" for x in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (jaccard.one_of_each(docs, LIKE), mixing.mix_documents(docs)):
        assert frame.columns == docs.columns
        got = {tuple(r) for r in frame.collect()}
        assert got and got <= set(rows)
