"""A hidden Markov language model of word sequences, trained and scored exactly.

A hidden state emits a class of words, and the class a word. A word's class is a hash of
its last three bytes, so the emissions of a state are a table of bounded size, while the
words within the classes have their counts over the whole training corpus. Each round of
Baum-Welch adds up expected counts of every training text on the executors; the sums
have one row per class. The first round starts from states that differ at random.
A text's likelihood is exact: the scaled forward recursion over all its classes, times
the probability of each word in its class.

For comparison ``base_score`` is the smoothed likelihood of the words one by one. Words
beyond the most frequent ones, whose counts are shipped, get their counts by a join.

Defined results: null text is empty and has one token, the end; repeated rows are scored
each; words that training has not seen share a tenth of a count; without any training
text all words are unseen. Columns other than doc_id and text are not read, whatever
their names. Training and scoring are over whole texts. Texts of over ``WHOLE`` tokens
are trained on in pieces of ``SEGMENT``, between which both recursions are carried on by
the pieces' products of transitions, so that the counts are those of the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitrank.llm.arrays import hashed_words, mix64
from orbitrank.session import cut_lineage

STATES = 8
#: Word classes; one more symbol is the end of a text.
CLASSES = 2_048
#: Rounds of Baum-Welch, each over all training texts.
ROUNDS = 16
#: Tokens of the longest text that is trained on in one piece, and of a longer one's pieces.
WHOLE, SEGMENT = 16_384, 256
#: Tokens whose recursions are held at once, unless one text has more.
HELD_TOKENS = 1 << 21
#: Tokens of the steps that are worked on together, which stay in the processor's cache.
BLOCK_TOKENS = 1 << 14
#: Steps after which probabilities are scaled; each multiplies them by 1e-13 or more.
RESCALE = 16
#: Most frequent words whose counts are shipped to the tasks: two megabytes.
SHIPPED_WORDS = 1 << 17
#: First bits of a word's hash by which it is looked up among them.
HEAD_BITS = 18
_HEAD = np.uint64(64 - HEAD_BITS)
#: Classes of counts to each doubling, from which the shipped words are chosen.
COUNT_CLASSES = 16
#: Distinct words that a task gathers before it sums them up.
GATHERED_WORDS = 2_000_000
SMOOTHING = 0.1
#: Expected counts are summed as whole parts of one, so that their order is no matter.
_PARTS = 1 << 16


def _classes(tails: np.ndarray) -> np.ndarray:
    return (mix64(tails.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.uint16)


@dataclass(frozen=True)
class States:
    """start (states), move (states x states), emit (symbols x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def drawn(states: int, seed: int = 7) -> States:
        """States that differ at random."""
        draw = np.random.default_rng(seed)
        emit = draw.gamma(1.0, 1.0, (CLASSES + 1, states)) + 0.5
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return States(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def of_counts(counts: np.ndarray) -> States:
        """Most likely states for expected counts: emissions, then moves, then starts."""
        states = counts.shape[1]
        emit = counts[:CLASSES + 1] + SMOOTHING
        move = counts[CLASSES + 1:CLASSES + 1 + states] + SMOOTHING
        start = counts[-1] + SMOOTHING
        return States(
            start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
        )

    def mean(self) -> np.ndarray:
        """The share of each state in the long run."""
        share = self.start
        for _ in range(64):
            share = share @ self.move
        return share / share.sum()


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of descending length, and how many sequences are longer than each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    ascending = np.sort(lengths)
    return order, len(lengths) - np.searchsorted(ascending, np.arange(longest), side="right")


def _step_blocks(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last step of blocks of at most ``BLOCK_TOKENS`` tokens, or one step."""
    begin, steps = 0, len(starts) - 1
    while begin < steps:
        end = int(np.searchsorted(starts, starts[begin] + BLOCK_TOKENS, side="right")) - 1
        end = min(steps, max(end, begin + 1))
        yield begin, end
        begin = end


def log_likelihoods(model: States, symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of every sequence of ``symbols``, by the scaled forward recursion."""
    order, active = _by_length(lengths)
    begins = begins[order]
    total = np.zeros(len(order))
    alpha, spare = np.tile(model.start, (len(order), 1)), np.empty((len(order), len(model.start)))
    widths = [*active.tolist(), 0]
    for step, n in enumerate(widths[:-1]):
        if step:
            np.dot(alpha[:n], model.move, out=spare[:n])
            alpha, spare = spare, alpha
        own = alpha[:n]
        own *= model.emit.take(symbols.take(begins[:n] + step, mode="clip"), axis=0, mode="clip")
        # Scaled now and then; texts that end here add what is left.
        if step % RESCALE == RESCALE - 1:
            scale = own.sum(axis=1)
            own /= scale[:, None]
            total[:n] += np.log10(scale)
        m = widths[step + 1]
        if m < n:
            total[m:n] += np.log10(own[m:].sum(axis=1))
    out = np.empty(len(order))
    out[order] = total
    return out


def expected_counts(
    model: States, segments: list[np.ndarray], firsts: np.ndarray,
    carried: np.ndarray | None = None, afters: np.ndarray | None = None, times: np.ndarray | None = None,
) -> np.ndarray:
    """Expected emissions, moves and starts of all segments, as ``States.of_counts`` takes them.

    ``times`` has how often each segment counts, once without it.

    ``carried`` is the states' distribution at the token before a segment, from which a
    move is counted, and ``afters`` the backward value at its last token. Without them a
    segment that is not a text's first begins in the mean distribution, and none goes on.
    """
    states = len(model.start)
    lengths = np.array([len(x) for x in segments])
    order, active = _by_length(lengths)
    firsts = firsts[order]
    times = np.ones(len(order)) if times is None else times[order].astype(np.float64)
    # Step by step, one row a token: what one step needs lies together.
    starts = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    begins = (np.cumsum(lengths) - lengths)[order]
    joined = np.concatenate(segments)
    symbols = np.empty(len(joined), dtype=joined.dtype)
    edges, widths = starts.tolist(), active.tolist()
    for step, n in enumerate(widths):
        joined.take(begins[:n] + step, out=symbols[edges[step]:edges[step] + n], mode="clip")
    blocks = list(_step_blocks(starts))
    back = np.ascontiguousarray(model.move.T)
    last = np.ones((len(order), states)) if afters is None else afters[order]
    come = None if carried is None else carried[order]
    before = model.mean() if come is None else come @ model.move
    alphas, scales = np.empty((len(joined), states)), {}
    for begin, end in blocks:
        seen = model.emit.take(symbols[edges[begin]:edges[end]], axis=0, mode="clip")
        for step in range(begin, end):
            at, n = edges[step], widths[step]
            alpha = alphas[at:at + n]
            if step:
                above = edges[step - 1]
                np.dot(alphas[above:above + n], model.move, out=alpha)
            else:
                alpha[:] = np.where(firsts[:, None], model.start, before)
            alpha *= seen[at - edges[begin]:at - edges[begin] + n]
            if step % RESCALE == 0:
                scale = scales[step] = 1 / alpha.sum(axis=1, keepdims=True)
                alpha *= scale
    # Backward, what a block of steps needs is taken again and summed up while it is at hand.
    counts = np.zeros((CLASSES + 1 + states + 1, states))
    moves = np.zeros((states, states))
    ahead = last[:0]
    for begin, end in reversed(blocks):
        first, stop = edges[begin], edges[end]
        own = symbols[first:stop].astype(np.intp)
        seen = model.emit.take(own, axis=0, mode="clip")
        # Beside each token: its backward value, and that of the next token with its emission.
        betas, nexts = np.empty_like(seen), np.zeros_like(seen)
        nexts[edges[end - 1] - first:edges[end - 1] - first + len(ahead)] = ahead
        for step in range(end - 1, begin - 1, -1):
            at, n, m = edges[step] - first, widths[step], len(ahead)
            beta = betas[at:at + n]
            if m:
                np.dot(ahead, back, out=beta[:m])
            if m < n:  # texts that end here: all their paths together weigh as often as they count
                ends = last[m:n]
                beta[m:] = ends * (times[m:n] / (alphas[first + at + m:first + at + n] * ends).sum(axis=1))[:, None]
            emitted = seen[at:at + n]
            if step in scales:
                emitted *= scales[step]
            if step > begin:
                above = edges[step - 1] - first
                ahead = np.multiply(emitted, beta, out=nexts[above:above + n])
            else:
                ahead = emitted * beta
        alpha = alphas[first:stop]
        moves += alpha.T @ nexts
        betas *= alpha  # from here on the states' shares
        for state in range(states):
            counts[:CLASSES + 1, state] += np.bincount(own, betas[:, state], CLASSES + 1)
        if begin == 0:
            counts[-1] = betas[:len(order)][firsts].sum(axis=0)
    if come is not None:
        moves += come[~firsts].T @ ahead[~firsts]
    counts[CLASSES + 1:CLASSES + 1 + states] = moves * model.move
    return counts


def _borders(model: States, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``carried`` and ``afters`` of the pieces of one text, all but the last of one length."""
    n, states = len(pieces), len(model.start)
    grid = np.zeros((len(pieces[0]), n), dtype=np.int64)
    for column, piece in enumerate(pieces):
        grid[:len(piece), column] = piece
    # Products of transition and emission over each piece; no move leads to the first token.
    across = np.tile(np.eye(states)[:, :, None], n)
    emit, onward = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    for step in range(len(grid)):
        m = n if step < len(pieces[-1]) else n - 1
        moved = onward @ across[:, :, :m]
        if step == 0:
            moved[:, :, 0] = np.eye(states)
        moved *= np.take(emit, grid[step, :m], axis=1)
        if step % RESCALE == 0:
            moved /= moved.sum(axis=(0, 1))
        across[:, :, :m] = moved
    across = np.moveaxis(across, 2, 0)
    carried, afters = np.zeros((n, states)), np.ones((n, states))
    alpha = model.start
    for i in range(n - 1):
        alpha = alpha @ across[i]
        alpha = carried[i + 1] = alpha / alpha.sum()
    beta = np.ones(states)
    for i in range(n - 1, 0, -1):
        beta = across[i] @ beta
        beta = afters[i - 1] = beta / (carried[i] @ beta)
    return carried, afters


def text_counts(model: States, texts: list[np.ndarray], times: np.ndarray | None = None) -> np.ndarray:
    """``expected_counts`` of whole texts of any length, a bounded number of tokens at once."""
    states = len(model.start)
    total = np.zeros((CLASSES + 2 + states, states))
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    times = np.ones(len(texts)) if times is None else np.asarray(times, dtype=np.float64)
    texts, times = [texts[i] for i in order], times[order]
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    parts = np.cumsum(lengths) // HELD_TOKENS
    whole = int(np.searchsorted(lengths, WHOLE, side="right"))
    for part in np.unique(parts[:whole]):
        low, high = np.searchsorted(parts[:whole], part), np.searchsorted(parts[:whole], part, side="right")
        own = texts[low:high]
        total += expected_counts(model, own, np.ones(len(own), dtype=bool), times=times[low:high])
    for text, count in zip(texts[whole:], times[whole:], strict=True):
        pieces = [text[at:at + SEGMENT] for at in range(0, len(text), SEGMENT)]
        carried, afters = _borders(model, pieces)
        firsts = np.arange(len(pieces)) == 0
        most = max(1, HELD_TOKENS // SEGMENT)
        for at in range(0, len(pieces), most):
            some = slice(at, at + most)
            total += count * expected_counts(model, pieces[some], firsts[some], carried[some], afters[some])
    return total


def _segments(docs: DataFrame) -> DataFrame:
    """symbols (16-bit, binary) of every different text, whole and with its end, and its times.

    Equal texts of a batch are one row before the shuffle, so copies never crowd a task.
    """
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made: Counter = Counter()
            for start, stop, _, before, tails in hashed_words(batch.column(0)):
                classes = _classes(tails)
                made.update(
                    np.append(classes[before[row]:before[row + 1]], np.uint16(CLASSES)).astype("<u2").tobytes()
                    for row in range(stop - start)
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.int64())], names=["symbols", "times"]
            )

    # As many parts as the texts are read in: each round is a task for each of them.
    parts = max(1, docs.select("text").rdd.getNumPartitions())
    emitted = docs.select("text").mapInArrow(batches, "symbols binary, times bigint")
    return emitted.repartition(parts, "symbols").groupBy("symbols").agg(F.sum("times").alias("times"))


def _round(texts: DataFrame, model: States) -> States:
    """One round of Baum-Welch over all texts."""
    states = len(model.start)
    columns = [f"c{i}" for i in range(states)]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 2 + states, states))
        for batch in stream:
            texts = [np.frombuffer(x, dtype="<u2") for x in batch.column(0).to_pylist()]
            total += text_counts(model, texts, batch.column(1).to_numpy())
        whole = np.rint(total * _PARTS).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(whole), dtype=np.int32)), *[pa.array(whole[:, i]) for i in range(states)]],
            names=["place", *columns],
        )

    schema = "place int, " + ", ".join(f"{c} bigint" for c in columns)
    summed = texts.select("symbols", "times").mapInArrow(batches, schema).groupBy("place").agg(*[F.sum(c).alias(c) for c in columns])
    counts = np.zeros((CLASSES + 2 + states, states))
    for row in summed.collect():  # one row per symbol and state
        counts[row["place"]] = row[1:]
    return States.of_counts(counts / _PARTS)


def train(texts: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> States:
    """Fit the states: every round is over all of ``texts``."""
    model = States.drawn(states)
    if texts.isEmpty():
        return model
    for _ in range(rounds):
        model = _round(texts, model)
    return model


def _summed(words: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every distinct word, its class and the sum of its counts."""
    order = np.argsort(words)
    ordered = words[order]
    heads = np.flatnonzero(np.append(np.ones(min(1, len(words)), dtype=bool), ordered[1:] != ordered[:-1]))
    if not len(heads):
        return words, classes, counts
    return ordered[heads], classes[order[heads]], np.add.reduceat(counts[order], heads)


def _word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), class and n of every distinct word of ``docs``."""
    def summed(words: list, classes: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _summed(np.concatenate(words), np.concatenate(classes), np.concatenate(counts))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            keys, kinds, n = summed(words, classes, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(kinds.astype(np.int32)), pa.array(n)],
                names=["word", "class", "n"],
            )

        words, classes, counts = [], [], []
        for batch in stream:
            for _, _, hashes, _, tails in hashed_words(batch.column(0)):
                keys, ends, n = _summed(hashes, tails, np.ones(len(hashes), dtype=np.int64))
                words.append(keys)
                classes.append(_classes(ends))
                counts.append(n)
                if sum(map(len, words)) >= GATHERED_WORDS:
                    if len(words) == 1:
                        yield made()
                        words, classes, counts = [], [], []
                    else:
                        words, classes, counts = ([x] for x in summed(words, classes, counts))
                        if len(words[0]) >= GATHERED_WORDS // 2:
                            yield made()
                            words, classes, counts = [], [], []
        if words:
            yield made()

    return docs.select("text").mapInArrow(batches, "word bigint, class int, n bigint").groupBy("word").agg(
        F.first("class").alias("class"), F.sum("n").alias("n")
    )


class Places:
    """Where words are among sorted ``words``: hashes are spread evenly, so their first bits tell nearly."""

    def __init__(self, words: np.ndarray) -> None:
        heads = np.bincount((words >> _HEAD).astype(np.intp), minlength=1 << HEAD_BITS)
        self.firsts = (np.cumsum(heads) - heads).astype(np.int32)
        # No word is above the last, so a search ends there.
        self.words = np.append(words, np.uint64(0xFFFFFFFFFFFFFFFF))

    def of(self, words: np.ndarray) -> np.ndarray:
        """``np.searchsorted`` of ``words``."""
        at = self.firsts[words >> _HEAD].astype(np.intp)
        below = np.flatnonzero(self.words[at] < words)
        while len(below):
            at[below] += 1
            below = below[self.words[at[below]] < words[below]]
        return at


@dataclass(frozen=True)
class Corpus:
    """Counts of the training corpus: the shipped words, and what the classes hold."""

    words: np.ndarray
    counts: np.ndarray
    class_logs: np.ndarray
    tokens: int
    distinct: int
    texts: int


def _read_counts(vocabulary: DataFrame, n_texts: int) -> Corpus:
    per_class = vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in per_class:
        totals[row["class"]], kinds[row["class"]] = row["n"], row["v"]
    # The counts above which there are no more words than may be shipped, from a histogram.
    kind = F.floor(F.log2("n") * COUNT_CLASSES)
    least, total = float("inf"), 0
    for number, words in sorted(vocabulary.groupBy(kind).count().collect(), reverse=True):
        total += words
        if total > SHIPPED_WORDS:
            break
        least = float(number)
    top = vocabulary.where(kind >= least).select("word", "n").toPandas()
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    # The end of a text is a token with a count of its own.
    return Corpus(
        words[order], top["n"].to_numpy(np.int64)[order],
        np.log10(totals + SMOOTHING * (kinds + 1)),
        int(totals.sum()) + n_texts, int(kinds.sum()) + (n_texts > 0), n_texts,
    )


def score_corpus(docs: DataFrame, training: Column) -> DataFrame:
    """Train on the rows of ``docs`` where ``training`` holds and score all of them.

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    taught = docs.where(training)
    vocabulary = cut_lineage(_word_counts(taught))
    corpus = _read_counts(vocabulary, taught.select("doc_id").count())
    model = train(cut_lineage(_segments(taught)))
    shipped = docs.sparkSession.sparkContext.broadcast((corpus, model))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, model = shipped.value
        frequent_logs = np.log10(corpus.counts + SMOOTHING)
        places = Places(corpus.words)
        for batch in stream:
            n_words, known, logs, class_logs, symbols = [], [], [], [], []
            rare_words, rare_counts, rare_rows = [], [], []
            for start, stop, hashes, before, tails in hashed_words(batch.column(1)):
                classes = _classes(tails)
                rows = stop - start
                if len(corpus.words):
                    at = np.minimum(places.of(hashes), len(corpus.words) - 1)
                    found = corpus.words[at] == hashes
                    own = np.where(found, frequent_logs[at], 0.0)
                else:
                    found, own = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes))
                row_of = np.repeat(np.arange(rows), np.diff(before))
                n_words.append(np.diff(before))
                known.append(np.bincount(row_of, found, rows))
                logs.append(np.bincount(row_of, own, rows))
                class_logs.append(np.bincount(row_of, corpus.class_logs[classes], rows))
                # Each text's classes, and the end.
                symbols.append(np.insert(classes, before[1:], np.uint16(CLASSES)))
                rest = np.flatnonzero(~found)
                order = rest[np.lexsort((hashes[rest], row_of[rest]))]
                fresh = np.ones(len(order), dtype=bool)
                fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row_of[order][1:] != row_of[order][:-1])
                heads = np.flatnonzero(fresh)
                rare_words.append(hashes[order[heads]])
                rare_counts.append(np.diff(heads, append=len(order)))
                rare_rows.append(np.bincount(row_of[order[heads]], minlength=rows))
            if not n_words:
                continue
            lengths = np.concatenate(n_words) + 1
            likely = log_likelihoods(
                model, np.concatenate(symbols), np.cumsum(lengths) - lengths, lengths
            )
            borders = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(rare_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths), pa.array(np.concatenate(known).astype(np.int64)),
                 pa.array(np.concatenate(logs).astype(np.float64)), pa.array(likely - np.concatenate(class_logs)),
                 pa.ListArray.from_arrays(borders, pa.array(np.concatenate(rare_words).view(np.int64))),
                 pa.ListArray.from_arrays(borders, pa.array(np.concatenate(rare_counts).astype(np.int64)))],
                names=["doc_id", "n_tokens", "known", "logs", "classes", "rare", "rare_n"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    partly = docs.select("doc_id", "text").mapInArrow(
        batches, f"doc_id {kind}, n_tokens bigint, known bigint, logs double, classes double, "
        "rare array<bigint>, rare_n array<bigint>",
    )
    # The row numbers are written with the rows, so they stay.
    partly = cut_lineage(partly.withColumn("row", F.monotonically_increasing_id()))
    rare = partly.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("own")).select(
        "row", F.col("own.rare").alias("word"), F.col("own.rare_n").alias("times")
    )
    counted = rare.join(vocabulary.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("rare_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    words = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    end = float(np.log10(corpus.texts + SMOOTHING))
    all_tokens = float(np.log10(corpus.tokens + SMOOTHING * (corpus.distinct + 1)))
    return partly.join(counted, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(corpus.texts > 0)).alias("n_known"),
        F.lit(corpus.tokens).cast("bigint").alias("train_tokens"),
        (words + end - F.col("n_tokens") * all_tokens).alias("base_score"),
        (words + F.col("classes")).alias("score"),
    )
