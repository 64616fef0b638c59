"""Encoding, decoding and counting against the libraries and against plain merging."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from orbitrank.llm import byte_pairs, piece_counts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = [
    *"aaabbcdeefghiijklmnnoopqrstuvwxyzABCXYZ'''..,!?<|> \n\t0123456789", "é", "ß", "😀", "中", "\0", "　", "İ",
    "Σ", "ΑΣ ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "K", "²", "Ⅷ", "½", "\x1c", "\x85", "\xa0",
    "the", "ing", "​", "ﬁ", "Å", "́", "अ", "ि", "</w>", "▁", "  ", "<s>",
]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    made = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 40))) for _ in range(4_000)]
    made += ["", " ", "a" * 3_000, "ab" * 999, "aaaa" * 77 + "b", " " * 50 + "x", "x" + " " * 50]
    return made + ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4_000))]


def test_tokens_and_text_equal_the_library(texts):
    library, tables = Tokenizer.from_file(WORD_BPE), byte_pairs.tokenizer(WORD_BPE)
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = tables.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids, ascii(text[:80])
        assert tables.decode(ids).decode() == library.decode(wanted.ids, skip_special_tokens=False)


def test_units_equal_plain_merging():
    import json

    with open(WORD_BPE, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ranks = {tuple(x): i for i, x in enumerate(model["merges"])}
    tables = byte_pairs.tokenizer(WORD_BPE)
    as_text = {b: c for c, b in byte_pairs.byte_symbols().items()}
    draw = random.Random(9)
    for _ in range(1_500):
        unit = "".join(draw.choice("aeinorstlhd" + "éü'") for _ in range(draw.randint(1, 18)))
        parts = [as_text[b] for b in unit.encode()]
        parts[-1] += "</w>"
        while len(parts) > 1:
            rank, at = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        assert tables.encode_unit(unit) == [model["vocab"][p] for p in parts], unit


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(byte_pairs, "KEPT_WORDS", 50)
    tables = byte_pairs.BytePairs(WORD_BPE)
    one, library = [f"w{i} common" for i in range(500)], Tokenizer.from_file(WORD_BPE)
    for text in one:
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tables.encode(text), "<u4").tolist() == wanted
        assert len(tables._kept) <= 50


def test_counts_equal_the_library(texts, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model, _ = piece_counts._model(PIECES)
    wanted = [len(x) for x in library.encode(texts, num_threads=1)]
    assert piece_counts._count_rows(texts, model, {}) == wanted
    monkeypatch.setattr(piece_counts, "KEPT_COUNTS", 10)
    kept: dict = {}
    assert [piece_counts._count_rows([t], model, kept)[0] for t in texts[:300]] == wanted[:300]


def test_queries_equal_the_libraries(spark, sf_dir):
    import hashlib

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    library, pieces = Tokenizer.from_file(WORD_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = entry.queries()["op7_bpe_roundtrip"](spark, sf_dir).collect()
    assert len(encoded) == len(texts)
    for r in encoded:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(
            library.decode(ids, skip_special_tokens=False).encode()
        ).hexdigest()
    for r in entry.queries()["op10_token_counts"](spark, sf_dir).collect():
        n = len(pieces.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 4096)
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode())
