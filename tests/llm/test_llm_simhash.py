"""SimHash fingerprints, BK-trees and classes against their definitions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from orbitrank.llm import simhash

SCHEMA = "doc_id bigint, text string, print string, key string, shard string, component_id string, lowest string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints):
    """Least place of each place's class, from all pairs."""
    values = np.array(prints, dtype=np.uint64)
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3):
            a, b = sorted((root(i), root(int(j))))
            label[b] = a
    return [root(i) for i in range(len(values))]


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA)


def _family(draw, n, flips):
    """Prints near one another: a chain in which each differs a little from one before."""
    made = [draw.getrandbits(64)]
    while len(made) < n:
        x = draw.choice(made)
        for _ in range(draw.randint(1, flips)):
            x ^= 1 << draw.randrange(64)
        made.append(x)
    return made


@pytest.mark.parametrize("text", ["", "one", "One TWO", "a b c", "a b c d", "A\tb\nc\x0bd \x1c e f", "É é 😀 x", "ab " * 50_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _print(text)


def test_fingerprint_over_slices(monkeypatch):
    text = " ".join(random.Random(3).choices("abcdefghijk", k=500))
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert simhash.fingerprint(text) == _print(text)


def test_trees_find_all_within_the_radius(monkeypatch):
    draw = random.Random(8)
    runs = [sorted(set(_family(draw, n, 5))) for n in (1, 2, 3, 40, 300, 1, 7)]
    prints = np.array([x for run in runs for x in run], dtype=np.uint64)
    lengths = np.array([len(x) for x in runs])
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    edges, children = simhash.build_trees(prints, first)
    assert len(edges) == len(prints) - len(runs)
    parents, distances = edges // 65, edges % 65
    assert np.array_equal(np.bitwise_count(prints[parents] ^ prints[children]), distances)
    query, node = simhash.search(prints, edges, children, prints, first)
    expected = {
        (i, j) for i in range(len(prints)) for j in range(len(prints))
        if first[i] == first[j] and int(prints[i] ^ prints[j]).bit_count() <= 3
    }
    assert len(query) == len(expected) and set(zip(query.tolist(), node.tolist(), strict=True)) == expected
    whole = simhash.shard_chains(prints, first)[0].to_pydict()
    monkeypatch.setattr(simhash, "PAIRS", 50)
    assert simhash.shard_chains(prints, first)[0].to_pydict() == whole


@pytest.mark.parametrize("crowd", [4_096, 64, 8])
def test_classes_at_every_level_of_division(spark, monkeypatch, crowd):
    """Crowded groups are divided thrice and then dealt over shards whose trees meet."""
    draw = random.Random(crowd)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = set(_family(draw, 600, 2)) | set(_family(draw, 200, 4)) | {draw.getrandbits(64) for _ in range(300)}
    centre = draw.getrandbits(64)
    prints |= {centre ^ 1 << i for i in range(27)} | {centre ^ 1 << i ^ 1 << j for i in range(27) for j in range(i)}
    prints = sorted(prints | {0, 1, (1 << 64) - 1})
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "print bigint")
    if crowd == 8:
        dealt = simhash.shards(frame)
        assert dealt.where("n_shards > 1").count() and dealt.where("group like '2:%'").count()
    edges = {(r["a"], r["b"]) for r in simhash.linked_prints(frame).collect()}
    place = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(prints)}
    label = np.arange(len(prints))
    if edges:
        one, two = (np.array([place[e[k]] for e in edges]) for k in (0, 1))
        simhash._joined(label, one, two)
    assert label.tolist() == _classes(prints)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    made = []
    for i in range(60):
        base = draw.choices(words, k=draw.choice([2, 8, 60, 200]))
        for copy in range(draw.choice([1, 1, 3, 6])):
            own = list(base)
            if copy:
                own[draw.randrange(len(own))] = draw.choice(words)
            made.append((1_000 - len(made), " ".join(own)))
    made += [(1, None), (2, ""), (3, " \n\t"), (None, ""), (None, "only without id here"), (None, "only without id here")]
    made += [(5, "twice the same row"), (5, "twice the same row"), (6, "TWICE the  same row"), (7, "x"), (8, "é x")]
    return made + [(9, "long text " * 30_000), (4, "long TEXT " * 30_000)]


def test_documents(spark, rows):
    got = simhash.near_copies(_docs(spark, rows).repartition(4))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [_print(text) for _, text in rows]
    classes = _classes(prints)
    members = defaultdict(list)
    for (doc_id, _), label in zip(rows, classes, strict=True):
        members[label].append(doc_id)
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    expected = [(r[0], f"{p:016x}", lowest[c]) for r, p, c in zip(rows, prints, classes, strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert len(members) < len(set(prints))


def test_no_rows(spark):
    assert simhash.near_copies(_docs(spark, [])).count() == 0


def test_query_on_the_given_table(spark, sf_dir):
    import __spark_entry__ as entry

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [_print(text) for _, text in docs]
    lowest = {}
    classes = _classes(prints)
    for (doc_id, _), label in zip(docs, classes, strict=True):
        lowest[label] = min(lowest.get(label, doc_id), doc_id)
    expected = sorted((d, f"{p:016x}", lowest[c]) for (d, _), p, c in zip(docs, prints, classes, strict=True))
    assert sorted(map(tuple, entry.queries()["op11_simhash"](spark, sf_dir).collect())) == expected
