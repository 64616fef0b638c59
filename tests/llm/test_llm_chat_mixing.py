"""Perspectives by hand, and what a mix has to keep."""

import pytest

from orbitrank.llm import chat, mixing

TALK = "conv_id bigint, turn bigint, role string, text string"
TEXTS = "doc_id bigint, text string, source string"


def test_every_participant_is_the_assistant_once(spark):
    rows = [(7, 0, "system", "s"), (7, 1, "ann", "Hi é"), (7, 2, "bob", "yo"), (7, 3, "ann", "ok")]
    got = {r["speaker"]: r for r in chat.rotate_perspectives(spark.createDataFrame(rows, TALK)).collect()}
    assert set(got) == {"ann", "bob"}
    assert got["bob"]["text"] == (
        "<|system|>\ns<|end|>\n<|user:ann|>\nHi é<|end|>\n<|assistant|>\nyo<|end|>\n<|user:ann|>\nok<|end|>\n"
    )
    for speaker, words in (("ann", ["Hi é<|end|>", "ok<|end|>"]), ("bob", ["yo<|end|>"])):
        r = got[speaker]
        assert [r["text"][s["begin"]:s["end"]] for s in r["spans"]] == words


def test_parts_make_the_same_dialogue(spark):
    rows = [(1, t, "ab"[t % 2], f"word {t}") for t in range(150)]
    frame = spark.createDataFrame(rows, TALK)
    whole = {r["speaker"]: r for r in chat.rotate_perspectives(frame, part_turns=1_000).collect()}
    parts: dict = {}
    for r in sorted(chat.rotate_perspectives(frame, part_turns=16).collect(), key=lambda r: r["part"]):
        text, spans = parts.get(r["speaker"], ("", []))
        assert r["offset"] == len(text) and r["n_turns"] <= 16
        parts[r["speaker"]] = (
            text + r["text"], spans + [(s["begin"] + r["offset"], s["end"] + r["offset"]) for s in r["spans"]]
        )
    for speaker, (text, spans) in parts.items():
        assert text == whole[speaker]["text"]
        assert spans == [(s["begin"], s["end"]) for s in whole[speaker]["spans"]]


def _level(sizes, budget):
    """Targets by sharing the excess again and again."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    capped: dict = {}
    while True:
        rest = budget - sum(capped.values())
        free = [s for s in sizes if s not in capped]
        share = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def corpus(spark):
    sizes = {"a": 3_000, "b": 40, "c": 500, "d": 20, "e": 900, "f": 90}
    rows = [
        (len(s) * 0 + i * 10 + ord(s), "w " * (1 + i % 5), s) for s, n in sizes.items() for i in range(n // 3)
    ]
    return spark.createDataFrame(rows, TEXTS)


def test_targets_are_met(corpus):
    got = mixing.mix_report(corpus.select("doc_id", "text", "source")).collect()
    per = {}
    for r in got:
        own = per.setdefault((r["source_size"], r["target"]), [0, 0])
        own[0] += r["size"]
        own[1] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    for (size, target), (counted, taken) in per.items():
        assert size == counted and target <= 3 * size + 1e-9
        assert abs(taken - target) <= 10
    sizes = {r["source"]: r["n"] for r in corpus.selectExpr(
        "source", "size(split(trim(text), ' ')) n").groupBy("source").sum("n").toDF("source", "n").collect()}
    wanted = _level(sizes, sum(sizes.values()))
    assert sorted(round(t, 6) for _, t in per) == sorted(round(t, 6) for t in wanted.values())


def test_reruns_and_partitions_agree(corpus):
    one = sorted(map(tuple, mixing.mix_report(corpus).collect()))
    two = sorted(map(tuple, mixing.mix_report(corpus.repartition(17, "text")).collect()))
    assert one == two


def test_small_ranges_change_nothing(corpus, monkeypatch):
    one = sorted(map(tuple, mixing.mix_report(corpus).collect()))
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(mixing, "TIME_RANGES", 64)
    monkeypatch.setattr(mixing, "SHIPPED_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_report(corpus).collect())) == one


@pytest.mark.parametrize("run", ["chat", "mix"])
def test_no_python_on_the_way(corpus, spark, run):
    if run == "chat":
        frame = chat.rotate_perspectives(spark.createDataFrame([(1, 1, "a", "b")], TALK))
    else:
        frame = mixing.mix_documents(corpus)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
