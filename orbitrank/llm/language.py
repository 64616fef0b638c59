"""Language identification by interpolated Kneser-Ney character models.

Texts are folded to symbols: letters in lower case, and one space for any run of other
characters. Per language, four-symbol counts of a bounded sample train an interpolated
Kneser-Ney model. The models share one sorted array of n-gram hashes for each order,
beside it a row of log probabilities with one column per language, so that one binary
search per character finds the probabilities of all languages. An n-gram that no
language has seen falls back to the shorter one times the context's left-over mass.

The language with the lowest cross-entropy per symbol is chosen. ``score`` is that
language's share of a soft maximum whose temperature is calibrated on sampled documents
that the models have not seen. So is, for each language, the cross-entropy above which a
text is rejected: a high quantile over the documents that the language is chosen for, and
a margin that widens for short texts, as the error of a mean does.

Defined results: null text, empty text and text without a letter are ``und`` with score
0 and are rejected; ties go to the language that is first by code point; documents with a
null language teach nothing; with no labelled document at all every text is ``und``.
Repeated rows are predicted each. Texts over ``PIECE_CHARS`` characters are scored in
pieces whose entropies are pooled. Only doc_id and text are read when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
ORDER = 4
#: Documents per language that the models may be fitted on, whatever the corpus size.
SAMPLE_DOCS = 3_000
#: Most frequent distinct n-grams kept of a language.
MAX_NGRAMS = 1_000_000
#: One in so many sampled documents calibrates instead of teaching.
CALIBRATE_EVERY = 8
PIECE_CHARS = 1 << 18
#: Rows whose texts are measured at once.
BATCH_ROWS = 512
#: Rejection asks for this many symbols; shorter texts are never rejected for their entropy.
REJECT_SYMBOLS = 40
#: Quantile of a language's calibration entropies that rejection starts from. A few
#: mislabelled or noisy documents do not move it.
REJECT_QUANTILE = 0.9
#: Entropy above that quantile, as a share of it, that rejects a long text.
REJECT_MARGIN = 0.6
#: A text of a third of so many symbols has twice the margin of a long one.
MARGIN_SYMBOLS = 400
_SPACE, _OTHER = 0, 27
_SYMBOLS = 256


def _symbol_table() -> np.ndarray:
    """Symbol of every code point of the basic plane: 0 unless a letter, a to z are 1 to 26."""
    table = np.zeros(1 << 16, dtype=np.uint8)
    for point in range(1 << 16):
        if chr(point).isalpha():
            table[point] = _OTHER + point % (_SYMBOLS - _OTHER)
    table[97:123] = np.arange(1, 27)
    return table


_TABLE: list[np.ndarray] = []


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts, each after a border of spaces, and where each begins."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    joined = "\n".join(texts)
    lowered = joined.lower()
    if len(lowered) != len(joined):  # a letter whose lower case is longer
        texts = [x.lower() for x in texts]
        lowered = "\n".join(texts)
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = _TABLE[0][np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        known = {p: chr(p).isalpha() for p in np.unique(points[high]).tolist()}
        letters = np.array([known[p] for p in points[high].tolist()])
        symbols[high] = np.where(letters, _OTHER + points[high] % (_SYMBOLS - _OTHER), 0)
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    keep = symbols != _SPACE
    keep[1:] |= symbols[:-1] != _SPACE  # the first space of a run
    where = np.cumsum(keep) - keep
    ends = np.append(begins[1:], len(symbols) + 1) - 1
    first = np.append(where, keep.sum())[np.minimum(begins, len(symbols))]
    last = np.append(where, keep.sum())[np.minimum(ends, len(symbols))]
    return symbols[keep], np.stack([first, last])


def _grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each place; before the first come spaces."""
    keys = symbols.astype(np.uint64)
    for back in range(1, order):
        keys[back:] |= symbols[:-back].astype(np.uint64) << np.uint64(8 * back)
    return keys


def _text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four-symbol hashes of all texts and the range of each text."""
    symbols, ranges = _symbols(texts)
    grams = _grams(symbols, ORDER)
    # The symbols before a text's first are its neighbour's: put spaces there.
    for place in range(ORDER - 1):
        at = ranges[0] + place
        at = at[at < ranges[1]]
        grams[at] &= np.uint64((1 << (8 * (place + 1))) - 1)
    return grams, ranges


@dataclass(frozen=True)
class LanguageModel:
    """Sorted n-gram hashes by order with log2 probabilities, and what is calibrated."""

    languages: tuple[str, ...]
    keys: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    left_over: tuple[tuple[np.ndarray, np.ndarray], ...]
    uniform: float
    temperature: float = 1.0
    reject_above: tuple[float, ...] = ()

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """log2 P(symbol | three before it), a row for every n-gram, a column per language."""
        return self._look_up(grams, ORDER)

    def _look_up(self, grams: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full((len(grams), len(self.languages)), self.uniform)
        grams = grams & np.uint64((1 << (8 * order)) - 1)
        keys, logs = self.keys[order - 1], self.logs[order - 1]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        found = keys[at] == grams
        out = logs[at]
        missing = np.flatnonzero(~found)
        if len(missing):
            lacking, numbers = np.unique(grams[missing], return_inverse=True)
            context_keys, masses = self.left_over[order - 1]
            contexts = lacking >> np.uint64(8)
            c = np.minimum(np.searchsorted(context_keys, contexts), len(context_keys) - 1)
            mass = np.where((context_keys[c] == contexts)[:, None], masses[c], 0.0)
            out[missing] = (mass + self._look_up(lacking, order - 1))[numbers]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol in every language, and symbols, of every text."""
        grams, ranges = _text_grams(texts)
        n = ranges[1] - ranges[0]
        sums = np.zeros((len(grams) + 1, len(self.languages)))
        if len(grams):
            np.cumsum(self.log_probabilities(grams), axis=0, out=sums[1:])
        return -(sums[ranges[1]] - sums[ranges[0]]), n

    def decide(self, bits: np.ndarray, n: np.ndarray):
        """Number of the best language (-1: undetermined), score, bits per symbol, rejected."""
        per = bits / np.maximum(n, 1)[:, None]
        best = np.where(n > 0, per.argmin(axis=1), -1)
        lowest = per.min(axis=1)
        share = 1 / np.exp2((lowest[:, None] - per) * self.temperature).sum(axis=1)
        level = np.array(self.reject_above or [float("inf")] * len(self.languages))[best]
        above = level * (1 + REJECT_MARGIN * np.sqrt(1 + MARGIN_SYMBOLS / np.maximum(n, 1)))
        rejected = (n == 0) | ((n >= REJECT_SYMBOLS) & (lowest > above))
        return best, np.where(n > 0, share, 0.0), np.where(n > 0, lowest, 0.0), rejected


def _kneser_ney(grams: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
    """Per order 1 to ORDER: (keys, probabilities) and (contexts, left-over mass).

    The highest order has counts, the lower ones how many symbols precede an n-gram.
    """
    by_order = {ORDER: (grams, counts)}
    for order in range(ORDER - 1, 0, -1):
        longer = by_order[order + 1][0]
        keys, types = np.unique(longer & np.uint64((1 << (8 * order)) - 1), return_counts=True)
        by_order[order] = (keys, types)
    tables, contexts = [], []
    lower_keys, lower = None, None
    for order in range(1, ORDER + 1):
        keys, counts = by_order[order]
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
        context, place = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.bincount(place, weights=counts)
        kinds = np.bincount(place)
        mass = discount * kinds / total
        if order == 1:
            shorter = np.full(len(keys), 1.0 / _SYMBOLS)
        else:
            tail = keys & np.uint64((1 << (8 * (order - 1))) - 1)
            shorter = lower[np.searchsorted(lower_keys, tail)]
        lower = (counts - discount) / total[place] + mass[place] * shorter
        lower_keys = keys
        tables.append((keys, lower))
        contexts.append((context, mass))
    return tables, contexts


def _assemble(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """One table per order for all languages together."""
    languages = tuple(sorted(counted))
    made = [_kneser_ney(*counted[x]) for x in languages]
    all_keys, all_logs, all_left = [], [], []
    uniform = -np.log2(_SYMBOLS)
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([m[0][order - 1][0] for m in made]))
        contexts = np.unique(np.concatenate([m[1][order - 1][0] for m in made]))
        logs = np.zeros((len(keys), len(languages)))
        left = np.zeros((len(contexts), len(languages)))
        for column, (tables, lefts) in enumerate(made):
            own_contexts, mass = lefts[order - 1]
            left[np.searchsorted(contexts, own_contexts), column] = np.log2(mass)
            # What this language lacks of the common keys falls back to its shorter n-gram.
            if order == 1:
                logs[:, column] = uniform
            else:
                tail = np.searchsorted(all_keys[-1], keys & np.uint64((1 << (8 * (order - 1))) - 1))
                logs[:, column] = all_logs[-1][tail, column]
            at = np.searchsorted(contexts, keys >> np.uint64(8))
            logs[:, column] += left[at, column]
            own, probabilities = tables[order - 1]
            logs[np.searchsorted(keys, own), column] = np.log2(probabilities)
        all_keys.append(keys)
        all_logs.append(logs)
        all_left.append((contexts, left))
    return LanguageModel(languages, tuple(all_keys), tuple(all_logs), tuple(all_left), uniform)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and pieces of text, so many together that they stay small."""
    rows, held, chars = [], [], 0
    for row, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), PIECE_CHARS):
            rows.append(row)
            held.append(text[at:at + PIECE_CHARS])
            chars += len(held[-1])
            if chars >= PIECE_CHARS:
                yield rows, held
                rows, held, chars = [], [], 0
    if rows:
        yield rows, held


def _small(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that few texts are held as strings."""
    for batch in stream:
        for at in range(0, len(batch), BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _measure(model: LanguageModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    bits = np.zeros((len(texts), len(model.languages)))
    n = np.zeros(len(texts), dtype=np.int64)
    for rows, held in _pieces(texts):
        some, length = model.entropies(held)
        np.add.at(bits, rows, some)
        np.add.at(n, rows, length)
    return bits, n


def _calibrated(model: LanguageModel, bits: np.ndarray, n: np.ndarray, labels: list[str]):
    """``model`` with the temperature of least log loss and the entropies that reject.

    A language that is chosen for no calibration document takes that of all documents.
    """
    numbers = {x: i for i, x in enumerate(model.languages)}
    truth = np.array([numbers.get(x, -1) for x in labels], dtype=np.int64)
    use = (truth >= 0) & (n > 0)
    if not use.any():
        return model
    per, truth, n = bits[use] / n[use, None], truth[use], n[use]
    own = per[np.arange(len(truth)), truth]
    losses = {}
    for temperature in (0.5, 1, 2, 4, 8, 16, 32):
        share = 1 / np.exp2((own[:, None] - per) * temperature).sum(axis=1)
        losses[temperature] = -np.log(np.maximum(share, 1e-12)).mean()
    long = n >= REJECT_SYMBOLS
    lowest, chosen = per.min(axis=1)[long], per.argmin(axis=1)[long]
    above = []
    for number in range(len(model.languages)):
        own = lowest[chosen == number] if (chosen == number).any() else lowest
        above.append(float(np.quantile(own, REJECT_QUANTILE, method="lower")) if len(own) else float("inf"))
    return replace(model, temperature=float(min(losses, key=losses.get)), reject_above=tuple(above))


def _count_grams(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to (lang, gram, n) counts of each batch."""
    for batch in stream:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            for _, held in _pieces(own):
                keys, counts = np.unique(_text_grams(held)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)),
                     pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"],
                )


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel | None:
    """Fit on at most about ``sample_docs`` documents of every language of ``labelled``.

    The documents with the lowest hashes of their texts are taken, one in
    ``CALIBRATE_EVERY`` of them to calibrate. The counts are made on the executors; the
    model has at most ``MAX_NGRAMS`` n-grams a language.
    """
    rows = labelled.where(F.col("lang").isNotNull())
    sizes = dict(rows.groupBy("lang").agg(F.count(F.lit(1))).collect())
    if not sizes:
        return None
    span = 1 << 20
    share = F.lit(0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, int(span * min(1.0, sample_docs / size))).otherwise(share)
    draw = F.xxhash64(F.lit("language"), F.col("doc_id").cast("string"))
    to_calibrate = F.pmod(F.shiftright(draw, 24), F.lit(CALIBRATE_EVERY)) == 0
    sample = rows.where((F.pmod(draw, F.lit(span)) < share) & F.col("text").isNotNull())
    table = (
        sample.where(~to_calibrate).select("lang", "text")
        .mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    made = {}
    for lang, own in table.groupby("lang"):
        own = own.nlargest(MAX_NGRAMS, "n").sort_values("gram")
        made[lang] = (own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy())
    if not made:
        return None
    model = _assemble(made)
    shipped = labelled.sparkSession.sparkContext.broadcast(model)

    def measured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(stream):
            bits, n = _measure(shipped.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(bits), pa.list_(pa.float64())), pa.array(n)],
                names=["lang", "bits", "n"],
            )

    held = sample.where(to_calibrate).select("lang", "text").mapInArrow(
        measured, "lang string, bits array<double>, n bigint"
    ).collect()
    if not held:
        return model
    return _calibrated(
        model, np.array([r["bits"] for r in held]), np.array([r["n"] for r in held]),
        [r["lang"] for r in held],
    )


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, bits (per symbol), n_symbols, rejected of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select(
            "doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(0.0).alias("bits"), F.lit(0).cast("bigint").alias("n_symbols"), F.lit(True).alias("rejected"),
        )
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in _small(stream):
            bits, n = _measure(model, batch.column(1).to_pylist())
            best, share, lowest, rejected = model.decide(bits, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(share),
                 pa.array(lowest), pa.array(n), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "bits", "n_symbols", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        batches, f"doc_id {kind}, lang_pred string, score double, bits double, "
        "n_symbols bigint, rejected boolean",
    )


def drop_rejected(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected.

    Without a model only texts without a letter are.
    """
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(stream):
            rejected = shipped.value.decide(*_measure(shipped.value, batch.column(place).to_pylist()))[3]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(batches, docs.schema)


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id's text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
