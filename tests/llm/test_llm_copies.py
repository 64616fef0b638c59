"""Fingerprints, the Jaccard join, components and search against their definitions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from orbitrank.llm import components, fingerprints, jaccard, top_k

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = "doc_id bigint, text string"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_entropy_classes():
    data = np.frombuffer(bytes(random.Random(2).choices(range(60), k=900)), dtype=np.uint8)
    got = fingerprints.entropy_classes(data)
    assert len(got) == 900 - fingerprints.WINDOW + 1
    most = math.log2(fingerprints.WINDOW)
    for at in range(0, len(got), 37):
        counts = Counter(data[at:at + fingerprints.WINDOW].tolist()).values()
        entropy = -sum(c / fingerprints.WINDOW * math.log2(c / fingerprints.WINDOW) for c in counts)
        assert abs(got[at] - entropy / most * 1_000) <= 1.01


def test_fingerprints_do_not_depend_on_place_or_blocks(monkeypatch):
    draw = random.Random(4)
    texts = [bytes(draw.choices(range(97, 123), k=draw.choice([0, 3, 31, 32, 40, 94, 95, 700, 5_000]))) for _ in range(80)]
    ranks = fingerprints.class_ranks(np.arange(fingerprints.CLASSES)[::-1] % 97)
    together = fingerprints.fingerprints(texts, ranks)
    turned = fingerprints.fingerprints(texts[::-1], ranks)[::-1]
    monkeypatch.setattr(fingerprints, "BLOCK", 100)
    blocks = fingerprints.fingerprints(texts, ranks)
    for i, text in enumerate(texts):
        alone = fingerprints.fingerprints([text], ranks)[0]
        for other in (turned[i], blocks[i], alone):
            assert np.array_equal(together[i], other)
        assert fingerprints.likeness(alone, together[i]) == 1.0
        assert bool(text) == bool(len(alone))


def test_texts_of_low_entropy_are_like_themselves_alone():
    ranks = fingerprints.class_ranks(np.arange(fingerprints.CLASSES))
    texts = [b"a" * 500, b"xy" * 400, b"", b"a" * 501, b"b" * 40, b"\0" * 70_000]
    made = fingerprints.fingerprints(texts, ranks)
    again = fingerprints.fingerprints(texts[::-1], ranks)[::-1]
    for i in range(len(texts)):
        for j in range(len(texts)):
            like = fingerprints.likeness(made[i], again[j])
            assert like == 1.0 if i == j else like < 0.5


def test_fingerprint_query(spark, sf_dir):
    rows = sorted(
        ((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True
    )
    got = {r["doc_id"]: r for r in entry.queries()["op8_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    same = defaultdict(set)
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        r = got[doc_id]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        same[text].add(r["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    long = [r for r in got.values() if r["n_chars"] > 600]
    assert np.mean([r["near_edited"] for r in long]) > 0.35
    assert np.mean([r["near_next"] for r in long]) < 0.15


def _brute(texts, words, per_cent):
    sets = {}
    for i, text in texts.items():
        own = _words(text)
        sets[i] = {tuple(own[k:k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else (
            {tuple(own)} if own else set()
        )
    where, root, links = defaultdict(list), {i: i for i in texts}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in where[g])
        for j, n in common.items():
            if 100 * n >= per_cent * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            where[g].append(i)
    return {i: (len(sets[i]), find(i), links[i]) for i in texts}


def _linked(frame, like):
    got = jaccard.linked_documents(frame, like).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got}


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies of many degrees, copies, a passage that all share, and short texts."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = draw.choices(vocabulary, k=60)
    texts, n = {}, 0
    for _ in range(14):
        base = draw.choices(vocabulary, k=draw.randint(5, 120))
        for _ in range(draw.randint(1, 14)):
            own = list(base)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            if draw.random() < 0.4:
                own += passage
            texts[n] = " ".join(own)
            n += 1
    for text in ("", "w1", "W1", "w1 w2", "w1  w2 ", "w1 w2 w3"):
        texts[n], n = text, n + 1
    return texts


@pytest.mark.parametrize("words, per_cent, tile", [(3, 90, 1 << 20), (3, 90, 150), (5, 80, 200), (1, 50, 300), (2, 100, 400)])
def test_join_equals_all_pairs(spark, copies, monkeypatch, words, per_cent, tile):
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", tile)
    monkeypatch.setattr(jaccard, "SET_SHINGLES", min(50, tile))
    if tile == 150:
        monkeypatch.setattr(jaccard, "SHIPPED_GIVERS", 0)
    frame = spark.createDataFrame(list(copies.items()), TEXTS)
    assert _linked(frame, jaccard.Likeness(words, per_cent)) == _brute(copies, words, per_cent)


def test_join_query_equals_all_pairs(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = entry.queries()["op9_jaccard_join"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == _brute(texts, 3, 90)


def test_one_of_each_class_stays(spark, copies):
    like = jaccard.Likeness(5, 80)
    frame = spark.createDataFrame(list(copies.items()), TEXTS)
    wanted = {c for _, c, _ in _brute(copies, 5, 80).values()}
    assert {r["doc_id"] for r in jaccard.one_of_each(frame, like).collect()} == wanted


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1_000, i) for i in range(1_001, 1_060)]
    edges += [(2_000 + i, 2_000 + (i + 1) % 7) for i in range(7)] + [(5, 5), (9_000, 9_000)]
    got = components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len({r["node"] for r in got}) == 201 + 60 + 7
    assert {(r["node"] >= 1_000) + (r["node"] >= 2_000): r["component"] for r in got} == {0: 0, 1: 1_000, 2: 2_000}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_search_equals_scoring_all(spark, monkeypatch):
    draw = random.Random(8)
    words = [f"t{int(draw.paretovariate(0.7))}" for _ in range(400)]
    texts = {i: " ".join(draw.choices(words, k=draw.randint(0, 60))) for i in range(300)}
    texts[41] = texts[40]
    monkeypatch.setattr(top_k, "SHARD_DOCS", 130)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 4)
    frame = spark.createDataFrame(list(texts.items()), TEXTS).repartition(3)
    got = defaultdict(list)
    for r in sorted(top_k.top_k(frame, frame["doc_id"] % 20 == 0, k=7).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    counts = {i: Counter(_words(t)) for i, t in texts.items()}
    mean = sum(sum(c.values()) for c in counts.values()) / len(texts)
    df = Counter(w for c in counts.values() for w in c)
    for query in range(0, 300, 20):
        scores = {}
        for i, c in counts.items():
            short = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            scores[i] = round(sum(
                math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + short)
                for w in counts[query] if w in c
            ), 9)
        best = sorted((-s, i) for i, s in scores.items() if s > 0)[:7]
        assert [i for i, _ in got[query]] == [i for _, i in best]
        assert np.allclose([s for _, s in got[query]], [-s for s, _ in best], atol=2e-9)


@pytest.mark.parametrize("mostly, pairs", [(0.75, 4_096), (1.0, 5)])
def test_a_batch_of_queries_is_searched_at_once(monkeypatch, mostly, pairs):
    monkeypatch.setattr(top_k, "MOSTLY", mostly)
    monkeypatch.setattr(top_k, "PAIRS", pairs)
    draw = np.random.default_rng(3)
    n, kinds = 1_000, 400
    times = (draw.random((n, kinds)) < np.linspace(0.2, 0.002, kinds)) * draw.integers(1, 4, (n, kinds))
    times[600:640] = times[600]  # copies: ties that go to the lower id
    words = np.sort(draw.integers(1, 2**63, kinds).astype(np.uint64))
    word, place = np.nonzero(times.T)
    row = {
        "ids": list(range(n)), "words": words.tobytes(), "heads": np.searchsorted(word, np.arange(kinds + 1)).tobytes(),
        "places": place.astype(np.uint16).tobytes(), "times": times.T[word, place].astype(np.uint32).tobytes(),
        "lengths": times.sum(axis=1).tobytes(),
    }
    weights = draw.random(kinds)
    asked = [
        {"query_id": i, "words": words[own].view(np.int64), "weights": weights[own]}
        for i in range(0, n, 20) if len(own := np.flatnonzero(times[i]))
    ]
    common, mean = words[:32], times.sum() / n
    block = top_k.Block.of(asked, common)
    queries, places, scores = top_k.Shard.read(row, block, common, mean).best(0, len(asked), 10)
    impacts = times * 2.2 / (times + 1.2 * (0.25 + 0.75 * times.sum(axis=1, keepdims=True) / mean))
    for number, query in enumerate(block.ids):
        exact = np.round(impacts @ (weights * (times[query] > 0)), 9)
        best = np.lexsort((np.arange(n), -exact))[:10]
        assert places[queries == number].tolist() == best.tolist()
        assert np.allclose(scores[queries == number], exact[best], atol=2e-9)


def test_tiles_are_bounded_in_shingles_and_sets(spark):
    rows = [(1, 15_000 + i % 3, i) for i in range(600)] + [(1, 2, 1_000 + i) for i in range(5_000)] + [(2, 9, 9_000)]
    frame = spark.createDataFrame(rows, "family bigint, size bigint, set bigint")
    tiles = jaccard._tiles(frame).groupBy("family", "tile").agg({"size": "sum", "set": "count"}).collect()
    assert sum(r["count(set)"] for r in tiles) == len(rows)
    assert max(r["sum(size)"] for r in tiles) <= 3 * jaccard.TILE_SHINGLES
    assert max(r["count(set)"] for r in tiles) <= 3 * jaccard.TILE_SHINGLES // jaccard.SET_SHINGLES


def test_linked_sets_share_a_part():
    draw, like, links = np.random.default_rng(3), jaccard.Likeness(3, 90), 0
    for _ in range(1_500):
        n = int(draw.integers(10, 400))
        most = n // 9 + 1
        own = draw.integers(0, 2**63, n + most, dtype=np.uint64)
        less, more = int(draw.integers(0, most)), int(draw.integers(0, most))
        one, two = np.unique(own[:n]), np.unique(own[less:n + more])
        common = len(np.intersect1d(one, two))
        if common < max(len(one), len(two)) and 100 * common >= 90 * (len(one) + len(two) - common):
            links += 1
            assert len(np.intersect1d(*jaccard.part_keys([one, two], like)))
    assert links > 200


def test_shingles_shared_by_chance_make_no_family(spark):
    """As many texts as these, of as few words, share some shingle with many others each."""
    draw, like = random.Random(8), jaccard.Likeness(3, 90)
    texts = [draw.choices("abcdefghijklmnopqrst", k=100) for _ in range(400)]
    near = [*texts[0][:50], "z", *texts[0][51:]]
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([*texts, near])], TEXTS)
    families = components.connected(jaccard._chains(jaccard._keyed(frame, like), like))
    assert families.count() == 2
    assert {r["doc_id"] for r in jaccard.linked_documents(frame, like).collect() if r["n_links"]} == {0, 400}
