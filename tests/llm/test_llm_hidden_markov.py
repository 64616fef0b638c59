"""The hidden Markov model against sums over all state paths, and the query against plain counts."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from orbitrank.llm import hidden_markov as hm

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _paths(model, symbols, start):
    states = len(model.start)
    for path in itertools.product(range(states), repeat=len(symbols)):
        p = start[path[0]]
        for i, state in enumerate(path):
            p *= model.emit[symbols[i], state] * (model.move[path[i - 1], state] if i else 1)
        yield path, p


def test_likelihood_and_counts_sum_over_all_paths():
    model = hm.States.drawn(3, seed=1)
    segments = [np.array(x, dtype=np.uint16) for x in ([5, 9, 5, hm.CLASSES], [7], [1, 2, 3])]
    firsts = np.array([True, False, True])
    lengths = np.array([len(x) for x in segments])
    got = hm.log_likelihoods(
        model, np.concatenate(segments).astype(np.int64), np.cumsum(lengths) - lengths, lengths
    )
    counts = np.zeros((hm.CLASSES + 1 + 3 + 1, 3))
    for i, own in enumerate(segments):
        total = sum(p for _, p in _paths(model, own, model.start))
        assert abs(got[i] - math.log10(total)) < 1e-10
        start = model.start if firsts[i] else model.mean()
        weighed = list(_paths(model, own, start))
        total = sum(p for _, p in weighed)
        for path, p in weighed:
            for at, state in enumerate(path):
                counts[own[at], state] += p / total
                if at:
                    counts[hm.CLASSES + 1 + path[at - 1], state] += p / total
            if firsts[i]:
                counts[-1, path[0]] += p / total
    assert np.allclose(hm.expected_counts(model, segments, firsts), counts)


def test_training_raises_the_likelihood(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice([f"{kind}{i}" for i in range(9)], 40)) for kind in "abcd" * 30]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    segments = hm._segments(docs)
    rows = segments.collect()
    held = [np.frombuffer(r["symbols"], dtype="<u2") for r in rows]
    lengths = np.array([len(x) for x in held])
    flat, begins = np.concatenate(held).astype(np.int64), np.cumsum(lengths) - lengths
    model, last = hm.States.drawn(4), -np.inf
    for _ in range(5):
        now = hm.log_likelihoods(model, flat, begins, lengths).sum()
        assert now > last
        model, last = hm._round(segments, model), now


def test_query_matches_plain_counts(spark, sf_dir):
    got = {r["doc_id"]: r for r in entry.queries()["op4_lm_scoring"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    words = {
        r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER)), "\0 end"] for r in docs
    }
    taught = Counter()
    for doc_id, own in words.items():
        if zlib.crc32(str(doc_id).encode()) % 10:
            taught.update(own)
    n, v = sum(taught.values()), len(taught)
    assert len(got) == len(words)
    for doc_id, own in words.items():
        r = got[doc_id]
        base = sum(math.log10((taught[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(taught[w] > 0 for w in own), n)
        assert abs(r["base_score"] - base) < 1e-7 * abs(base)
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_are_joined(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    held = docs["doc_id"] % 7 != 0
    whole = {r["doc_id"]: r for r in hm.score_corpus(docs, held).collect()}
    monkeypatch.setattr(hm, "SHIPPED_WORDS", 5)
    for r in hm.score_corpus(docs, held).collect():
        assert r["n_known"] == whole[r["doc_id"]]["n_known"]
        assert abs(r["base_score"] - whole[r["doc_id"]]["base_score"]) < 1e-6
        assert abs(r["score"] - whole[r["doc_id"]]["score"]) < 1e-6


def test_cut_texts_give_the_counts_of_whole_ones(monkeypatch):
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, hm.CLASSES + 1, n).astype(np.uint16) for n in (1, 40, 41, 64, 700)]
    model = hm.States.drawn(3, seed=2)
    whole = hm.expected_counts(model, texts, np.ones(len(texts), dtype=bool))
    monkeypatch.setattr(hm, "WHOLE", 40)
    monkeypatch.setattr(hm, "SEGMENT", 8)
    monkeypatch.setattr(hm, "HELD_TOKENS", 100)
    cut = hm.text_counts(model, texts)
    assert np.allclose(cut, whole)
    assert abs(cut[hm.CLASSES + 1:-1].sum() - sum(len(x) - 1 for x in texts)) < 1e-6


def test_every_round_is_over_all_texts(spark, monkeypatch):
    docs = spark.createDataFrame([("one and the same boilerplate " * 60,)] * 30 + [("quite another text",)], "text string")
    texts, seen = hm._segments(docs), []
    of_counts = hm.States.of_counts
    monkeypatch.setattr(hm.States, "of_counts", staticmethod(lambda counts: seen.append(counts) or of_counts(counts)))
    hm.train(texts)
    tokens = 30 * (5 * 60 + 1) + 4
    assert len(seen) == hm.ROUNDS
    for counts in seen:
        assert abs(counts[:hm.CLASSES + 1].sum() - tokens) < 1
        assert abs(counts[hm.CLASSES + 1:-1].sum() - (tokens - 31)) < 1
        assert abs(counts[-1].sum() - 31) < 0.1


def test_copies_count_as_often_as_they_occur(monkeypatch):
    draw = np.random.default_rng(6)
    texts = [np.append(draw.integers(0, hm.CLASSES, n), hm.CLASSES).astype("<u2") for n in (0, 1, 5, 40, 300, 700)]
    times = np.array([3, 1, 2, 5, 2, 4])
    model = hm.States.drawn(4)
    monkeypatch.setattr(hm, "WHOLE", 200)
    monkeypatch.setattr(hm, "SEGMENT", 64)
    repeated = [x for x, n in zip(texts, times, strict=True) for _ in range(n)]
    assert np.allclose(hm.text_counts(model, texts, times), hm.text_counts(model, repeated))


def test_segments_are_different_texts(spark):
    rows = [("a b",), ("a b",), ("A  b",), (None,), ("",), ("c",)] * 40
    got = hm._segments(spark.createDataFrame(rows, "text string").repartition(5)).collect()
    assert sorted(r["times"] for r in got) == [40, 80, 120]


def test_long_texts_share_their_steps(monkeypatch):
    steps = []
    counted = hm.expected_counts

    def watched(model, segments, *rest, **named):
        steps.append(max(map(len, segments)))
        return counted(model, segments, *rest, **named)

    monkeypatch.setattr(hm, "expected_counts", watched)
    texts = [np.full(3_000 + i, 5, dtype=np.uint16) for i in range(300)]
    total = hm.text_counts(hm.States.drawn(2), texts)
    # A step costs the same for few texts as for many: 900,000 tokens take those of one text.
    assert steps == [3_299]
    assert np.isclose(total[5].sum(), sum(map(len, texts)))
    assert np.isclose(total[-1].sum(), len(texts))


def test_blocks_of_steps_give_the_same_counts(monkeypatch):
    draw = np.random.default_rng(8)
    texts = [draw.integers(0, hm.CLASSES + 1, n).astype(np.uint16) for n in (1, 2, 17, 17, 33, 60)]
    firsts, times = np.array([True, False, True, True, False, True]), np.arange(1, 7)
    carried, afters = draw.random((6, 3)), draw.random((6, 3))
    model = hm.States.drawn(3, seed=4)
    whole = hm.expected_counts(model, texts, firsts, carried, afters, times)
    for most in (1, 5, 64):
        monkeypatch.setattr(hm, "BLOCK_TOKENS", most)
        assert np.allclose(hm.expected_counts(model, texts, firsts, carried, afters, times), whole, rtol=1e-12)
    assert np.isclose(whole[:hm.CLASSES + 1].sum(), sum(len(x) * n for x, n in zip(texts, times, strict=True)))


def test_two_million_tokens_share_their_steps(monkeypatch):
    steps = []
    counted = hm.expected_counts
    monkeypatch.setattr(hm, "expected_counts", lambda m, own, *a, **k: steps.append(len(own)) or counted(m, own, *a, **k))
    total = hm.text_counts(hm.States.drawn(2), [np.full(2_000, 5, dtype=np.uint16)] * 1_000)
    assert steps == [1_000]
    assert np.isclose(total[5].sum(), 2_000_000)


def test_long_sequences_keep_their_likelihood():
    draw = np.random.default_rng(9)
    model = hm.States.drawn(3, seed=5)
    texts = [draw.integers(0, hm.CLASSES + 1, n) for n in (500, 16, 1, 15, 17, 32)]
    lengths = np.array([len(x) for x in texts])
    got = hm.log_likelihoods(model, np.concatenate(texts), np.cumsum(lengths) - lengths, lengths)
    for i, own in enumerate(texts):
        alpha, expected = model.start, 0.0
        for at, symbol in enumerate(own):
            alpha = (alpha @ model.move if at else alpha) * model.emit[symbol]
            expected += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert abs(got[i] - expected) < 1e-9


def test_words_are_found_by_their_first_bits():
    draw = np.random.default_rng(10)
    top = np.iinfo(np.uint64).max
    for n in (1, 2, 5_000):
        words = np.unique(draw.integers(0, top, n, dtype=np.uint64, endpoint=True) >> np.uint64(draw.integers(0, 40)))
        asked = np.concatenate([words, words + np.uint64(1), words - np.uint64(1), np.array([0, 1, top], dtype=np.uint64)])
        assert np.array_equal(hm.Places(words).of(asked), np.searchsorted(words, asked))


def test_counts_of_equal_words_are_summed():
    words, kinds, n = hm._summed(
        np.array([7, 3, 7, 2**63 + 1, 3, 7], dtype=np.uint64), np.array([1, 2, 1, 4, 2, 1]), np.array([1, 10, 100, 5, 20, 1_000])
    )
    assert (words.tolist(), kinds.tolist(), n.tolist()) == ([3, 7, 2**63 + 1], [2, 1, 4], [30, 1_101, 5])
    empty = hm._summed(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert [len(x) for x in empty] == [0, 0, 0]
