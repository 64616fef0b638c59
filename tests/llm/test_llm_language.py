"""The character models against a direct recursion, and held-out accuracy of the query."""

from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as entry
from orbitrank.llm import language


def _direct(texts):
    """Interpolated Kneser-Ney probability of (context, symbol) by its definition."""
    symbols = [language._symbols([t])[0].tolist() for t in texts]
    grams = Counter()
    for own in symbols:
        padded = [0, 0, 0, *own]
        grams.update(tuple(padded[i:i + 4]) for i in range(len(own)))
    tables = {4: grams}
    for order in (3, 2, 1):
        before = defaultdict(set)
        for g in tables[order + 1]:
            before[g[1:]].add(g[0])
        tables[order] = Counter({g: len(x) for g, x in before.items()})
    discounts = {}
    for order, table in tables.items():
        once, twice = (sum(v == n for v in table.values()) for n in (1, 2))
        discounts[order] = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))

    def p(context, symbol):
        if context is None:
            return 1 / 256
        table, d = tables[len(context) + 1], discounts[len(context) + 1]
        shorter = p(context[1:] if context else None, symbol)
        own = {g: v for g, v in table.items() if g[:-1] == context}
        if not own:
            return shorter
        total = sum(own.values())
        return max(own.get((*context, symbol), 0) - d, 0) / total + d * len(own) / total * shorter

    return p


def test_models_match_the_definition():
    taught = {"a": ["banana bandana, cabana!", "a band ran"], "b": ["zebra zoo ooze", "bazooka fez"]}
    counted = {}
    for lang, texts in taught.items():
        grams = np.concatenate([language._text_grams([t])[0] for t in texts])
        counted[lang] = np.unique(grams, return_counts=True)
    model = language._assemble(counted)
    for column, lang in enumerate(model.languages):
        p = _direct(taught[lang])
        contexts = [(0, 0, 0), (0, 2, 1), (1, 14, 1), (26, 5, 2), (9, 9, 9), (0, 0, 26)]
        for context in contexts:
            for symbol in (0, 1, 2, 14, 15, 26, 77):
                key = 0
                for s in (*context, symbol):
                    key = key << 8 | s
                got = model.log_probabilities(np.array([key], dtype=np.uint64))[0, column]
                assert abs(2.0**got - p(context, symbol)) < 1e-12, (lang, context, symbol)


def test_symbols_fold_case_and_all_but_letters():
    symbols, ranges = language._symbols(["  Ab--c!", "É é", "", "12"])
    assert symbols[ranges[0][0]:ranges[1][0]].tolist() == [1, 2, 0, 3, 0]
    assert symbols[ranges[0][1]:ranges[1][1]].tolist()[0::2] == [symbols[ranges[0][1]]] * 2
    assert (ranges[1] - ranges[0]).tolist() == [5, 3, 0, 0]


def test_texts_are_scored_wherever_they_stand():
    texts = ["banana band", "x", "", "Ünï ćode ok", "zebra"]
    counted = {"a": np.unique(language._text_grams(texts)[0], return_counts=True)}
    model = language._assemble(counted)
    together = model.entropies(texts)
    alone = [model.entropies([t]) for t in texts]
    assert np.allclose(together[0], np.concatenate([x[0] for x in alone]))
    assert together[1].tolist() == [int(x[1][0]) for x in alone]


def test_held_out_accuracy(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = entry.queries()["op2_language_id"](spark, sf_dir).join(truth, "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert not any(r["rejected"] for r in got)


def test_foreign_noise_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.learn(docs)
    draw = np.random.default_rng(0)
    noise = "".join(draw.choice(list("qxzjkwvçñßыжщюя中文 "), 2_000))
    bits, n = language._measure(model, [noise])
    assert model.decide(bits, n)[3].tolist() == [True]


#: Sentences of languages that no document is labelled with.
UNTAUGHT = [
    "La lingua italiana è parlata da molte persone in tutto il mondo e ha una lunga storia letteraria.",
    "Suomen kieli on monille ihmisille vaikea oppia, mutta sen kirjallisuus on rikasta ja kaunista.",
]


def _judged(model, texts):
    return model.decide(*language._measure(model, texts))[3].tolist()


def test_untaught_languages_are_rejected_and_short_clean_texts_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.learn(docs)
    assert _judged(model, UNTAUGHT) == [True, True]
    texts = [r["text"] for r in docs.where("length(text) > 400").select("text").limit(200).collect()]
    for length in (60, 100, 200, 400):
        assert not any(_judged(model, [t[:length] for t in texts]))


def test_noisy_labelled_rows_do_not_lift_the_threshold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and lang is not null")
    rows = docs.orderBy("doc_id").select("lang", "text").collect()
    langs, texts = [r["lang"] for r in rows], [r["text"] for r in rows]
    counted = {}
    for lang in set(langs):
        own = [t for x, t in list(zip(langs, texts, strict=True))[::2] if x == lang]
        counted[lang] = np.unique(language._text_grams(own)[0], return_counts=True)
    model = language._assemble(counted)
    draw = np.random.default_rng(4)
    noisy = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 4_000))]
    measured = language._measure(model, [*texts[1::2], *noisy])
    model = language._calibrated(model, *measured, [*langs[1::2], "en"])
    assert _judged(model, [*noisy, *UNTAUGHT]) == [True, True, True]
    assert not any(_judged(model, texts[1::2]))
