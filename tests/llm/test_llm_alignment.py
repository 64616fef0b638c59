"""Alignment of two tokenizers against whole-text encoding and overlap by definition."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from orbitrank.llm import alignment
from orbitrank.llm.byte_pairs import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, row string, pair string, pairs string, n_best string, best string"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _tokens(text, libraries):
    a, b = libraries
    symbols = byte_symbols()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
    a_bytes = [bytes(symbols[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = []
    for i in b_ids:
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    return a_ids, b_ids, a_bytes, b_bytes


def _spans(ids, tokens):
    at = 0
    for i, token in zip(ids, tokens, strict=True):
        yield i, at, at + len(token)
        at += len(token)


def _plain(text, libraries):
    """Counts, groups and link counter from byte ranges alone."""
    found = _tokens(text or "", libraries)
    if found is None:
        return (0, 0, 0, 0, ""), Counter()
    a, b = list(_spans(found[0], found[2])), list(_spans(found[1], found[3]))
    both = sorted({e for *_, e in a} & {e for *_, e in b})
    links, groups = Counter(), []
    sides = [[[] for _ in both] for _ in (a, b)]
    for side, spans in zip(sides, (a, b), strict=True):
        for x in spans:
            side[bisect.bisect_right(both, x[1])].append(x)
    for of_a, of_b in zip(*sides, strict=True):
        for i, low, high in of_a:
            for j, other_low, other_high in of_b:
                if low < other_high and other_low < high:
                    links[i, j] += 1
        groups.append("|".join(",".join(str(x[0]) for x in side) for side in (of_a, of_b)))
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return (len(a), len(b), len(groups), sum(links.values()), digest), links


def _expected(rows, libraries):
    seen = [(_id, *_plain(text, libraries)) for _id, text in rows]
    documents = Counter(pair for _, _, links in seen for pair in links)
    top = defaultdict(int)
    for (a, _), n in documents.items():
        top[a] = max(top[a], n)
    return sorted(
        ((_id, *counts[:4], sum(n for p, n in links.items() if documents[p] == top[p[0]]),
          sum(n * documents[p] for p, n in links.items()), counts[4]) for _id, counts, links in seen), key=repr,
    )


def _texts():
    draw = random.Random(12)
    words = ["the", "Haus", "été", "naïve", "don't", "123456", "!!", "<|endoftext|>", "<s>", "<0x41>", "😀", "日本語", "ﬁ",
             "x" * 60, "́", "_", "a\nb", "\x85", " ", "\x1c", "Z͑ͫ"]
    gaps = [" ", " ", " ", "  ", "\n", "\n ", " \n", "\t", "   ", "", "　", "   ", "\r\n"]
    made = ["".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(1, 25))) for _ in range(500)]
    made += [draw.choice(gaps) + x + draw.choice(gaps) for x in made[:200]]
    return made + [" ", "  ", "\n", "a", "▁", "a ▁b", "a▁ b", "\x00", "é", " a", "a ", "." * 500, "ab" * 2_000]


def test_slices_of_texts_as_each_alone(libraries):
    both = alignment.Tokenizers(A, B)
    texts = _texts()
    for text, got in zip(texts[:50], both.totals(texts), strict=False):
        assert got[:5] == both.totals([text])[0][:5]
    for text, got in zip(texts, both.totals(texts), strict=True):
        counts, links = _plain(text, libraries)
        assert got[:5] == counts, text
        assert dict(zip(got[5].tolist(), got[6].tolist(), strict=True)) == {a << 32 | b: n for (a, b), n in links.items()}


def test_random_code_points(libraries):
    draw = random.Random(1)
    texts = []
    for _ in range(1_500):
        pool = [chr(c) for c in (draw.randrange(0x11_0000) for _ in range(6)) if not 0xD800 <= c < 0xE000]
        texts.append("".join(draw.choices([*pool, " ", " ", "a", "\n"], k=20)))
    both = alignment.Tokenizers(A, B)
    for text, got in zip(texts, both.totals(texts), strict=True):
        assert got[:5] == _plain(text, libraries)[0], repr(text)


def test_every_code_point(libraries):
    """The byte-level side against its library, around each code point of five planes."""
    both = alignment.Tokenizers(A, B)
    for low in range(0, 0x50000, 0x8000):
        texts = [f"a{c}1{c}{c}b {c}!{c} " for c in map(chr, range(low, low + 0x8000)) if not "\ud800" <= c <= "\udfff"]
        if not texts:
            continue
        expected = libraries[0].encode_batch_fast([f" {x}" for x in texts], add_special_tokens=False)
        for text, x in zip(texts, expected, strict=True):
            assert both._a.encode_to_numpy(f" {text}", disallowed_special=()).tolist() == x.ids, repr(text)


@pytest.fixture(scope="module")
def rows():
    made = list(enumerate(_texts()))
    return made + [(1, None), (2, ""), (None, "no id"), (None, "no id"), (7, "same"), (7, "same"), (9, "word wort " * 10_000)]


@pytest.mark.parametrize("shipped", [alignment.SHIPPED_PAIRS, 40, 0])
def test_documents(spark, rows, libraries, shipped):
    frame = spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA).repartition(4)
    got = alignment.align_corpus(frame, A, B, shipped=shipped)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=repr) == _expected(rows, libraries)


def test_no_rows(spark):
    assert alignment.align_corpus(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_query_on_the_given_table(spark, sf_dir, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    small = [r for r in docs if len(r[1] or "") < 20_000]
    got = entry.queries()["op13_tokenizer_alignment"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for doc_id, text in small:
        r = by[doc_id]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == _plain(text, libraries)[0]
        assert r["n_best"] <= r["n_links"] <= r["count_sum"]
