"""The fill-in-middle transformation against its definition, and the edge cases of the operator."""

import hashlib
import random

import pytest

from orbitrank.llm import fill_middle

SCHEMA = "doc_id bigint, text string, row string, place string, piece string, n string, form string"


def _plain(doc_id, text):
    """What the definition gives, without pieces."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (out, text)]
    return (doc_id, n, form, *sizes, *digests)


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA)


def _got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    alphabet = "ab <>PSM😀é\n"
    made = [(i, "".join(draw.choices(alphabet, k=draw.choice([1, 2, 3, 30, 300])))) for i in range(400)]
    made += [(1, None), (2, ""), (None, "no id"), (None, "no id"), (None, None), (7, "same"), (7, "same")]
    made += [(500 + i, "a long text, 😀 " * 20_000) for i in range(12)]
    return made + [(600 + i, "x<M" * i) for i in range(40)]


def test_matches_the_definition(spark, rows):
    got = fill_middle.fill_in_middle(_docs(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert _got(got) == sorted((_plain(*r) for r in rows), key=repr)
    assert {r[2] for r in _got(got)} == {"plain", "psm", "spm"}


def test_small_pieces_give_the_same(rows, monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE_UNITS", 7)
    for doc_id, text in rows[:450]:
        text = text or ""
        chosen = fill_middle.cut(doc_id, text)
        made = list(fill_middle.pieces(chosen, text))
        assert hashlib.sha256(b"".join(made)).hexdigest() == _plain(doc_id, text)[5]
        assert all(len(x.decode()) <= 7 + 3 for x in made)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 64])
def test_parser_reads_any_cutting(rows, width):
    for doc_id, text in rows[:450]:
        text = text or ""
        chosen = fill_middle.cut(doc_id, text)
        out = b"".join(fill_middle.pieces(chosen, text))
        parser = fill_middle.Parser(chosen.form)
        found = [x for at in range(0, len(out), width) for x in parser.feed(out[at:at + width])]
        found += parser.feed(b"", last=True)
        assert b"".join(x for _, x in sorted(found)) == text.encode()


def test_every_form_and_no_rows(spark, rows):
    always = _got(fill_middle.fill_in_middle(_docs(spark, rows), plain_from=100, spm_under=100))
    assert {r[2] for r in always} == {"plain", "spm"}
    assert sorted((repr(r[0]), r[6]) for r in always) == sorted((repr(r[0]), _plain(*r)[6]) for r in rows)
    assert fill_middle.fill_in_middle(_docs(spark, [])).count() == 0


def test_one_shuffle_of_the_texts(spark, rows):
    plan = fill_middle.fill_in_middle(_docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ids_of_another_kind(spark):
    frame = spark.createDataFrame([("12", "some text of a document"), (None, "x")], "doc_id string, text string")
    expected = [_plain("12", "some text of a document"), _plain(None, "x")]
    assert _got(fill_middle.fill_in_middle(frame)) == sorted(expected, key=repr)
