"""Alignment of two tokenizers' tokens of one text by their common byte offsets.

1. Each text is encoded by both tokenizers. The ends of the tokens in bytes are keys of a
   dictionary from end to index, one for each side; the ends that both have, sorted, cut
   both lists of ids into groups. In a group, all tokens whose bytes overlap are linked.
2. A row of the table that this writes has a text's counts, the digest of its groups and
   its different id pairs with how often they are linked.
3. The pairs are counted over documents, and each first id's highest count is found.
4. The counts of the commonest pairs, at most ``SHIPPED_PAIRS``, go to the rows; pairs
   beyond are joined by key. What is common enough to crowd a task of that join is
   therefore never in it, and what is shipped is bounded however large the corpus.

Texts are encoded whole by the tokenizers' libraries.

Defined results: null and empty texts, and texts that either side's tokens do not spell
byte by byte after one space, have no tokens: counts of zero and an empty ``groups``
digest; repeated rows are documents of their own. Special strings are plain text.
Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrank.llm.byte_pairs import byte_symbols
from orbitrank.session import cut_lineage, scratch_path

#: Id pairs whose counts are shipped, the commonest.
SHIPPED_PAIRS = 1 << 20
#: Characters of text that are aligned together.
SLICE_CHARS = 1 << 20
#: Classes of counts to each doubling, from which the shipped pairs are chosen.
CLASSES = 16
_SPACE = "▁"
#: Splits a text into the units that merges never leave (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _check_merges(merges: list, ranks: dict[bytes, int], symbols: dict[str, int]) -> None:
    """Raise unless the ids of merged entries rise as their merges do."""
    last = -1
    for merge in merges:
        joined = "".join(merge) if isinstance(merge, list) else merge.replace(" ", "")
        made = ranks[bytes(symbols[c] for c in joined)]
        if made <= last:
            raise ValueError("ids must rise with the merges that make them")
        last = made


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Indexes of both sides' tokens that end at the same offsets, in order."""
    a_index = dict(zip(a_ends, range(len(a_ends)), strict=True))
    b_index = dict(zip(b_ends, range(len(b_ends)), strict=True))
    common = sorted(a_index.keys() & b_index.keys())
    return list(map(a_index.__getitem__, common)), list(map(b_index.__getitem__, common))


def linked_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the two tokens of each link, in order of their bytes.

    Each stretch between two ends, of either side, lies in one token of each side, and two
    tokens that overlap share one stretch: in every slice the stretches are its links.
    """
    stretches = np.concatenate([a_ends, b_ends])
    stretches.sort(kind="stable")  # two sorted runs
    stretches = stretches[np.diff(stretches, prepend=-1) > 0]
    return np.searchsorted(a_ends, stretches), np.searchsorted(b_ends, stretches)


class Tokenizers:
    """A byte-level tokenizer (a) and a piece model (b), read once in each worker.

    The byte-level one's entries are its merges' ranks, so ``tiktoken`` gives the same ids.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            described = json.load(file)
        symbols = byte_symbols()
        added = {x["content"] for x in described["added_tokens"]}
        ranks = {
            bytes(symbols[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in added
        }
        _check_merges(described["model"]["merges"], ranks, symbols)
        self._a = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self._a_bytes = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self._a_bytes[i] = token
        self._b_bytes = [self._piece(i) for i in range(len(self._b))]
        self._a_size = np.array([len(x) for x in self._a_bytes])
        self._b_size = np.array([len(x) for x in self._b_bytes])
        # How an id is written inside a group and at the end of its side.
        self._a_text, self._b_text = (
            np.array([f"{i}{mark}" for mark in marks for i in range(len(side))], dtype=object)
            for marks, side in ((",|", self._a_bytes), (",;", self._b_bytes))
        )

    def _piece(self, number: int) -> bytes:
        piece = self._b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(number) else piece.replace(_SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of every text; none where they do not spell a space and the text."""
        out, none = [], np.zeros(0, dtype=np.int64)
        for text, b in zip(texts, self._b.encode(texts, num_threads=1), strict=True):
            whole = f" {text}".encode("utf-8", "replace")
            if text and b"".join(map(self._b_bytes.__getitem__, b)) == whole:
                # The byte-level side spells every text.
                a = self._a.encode_to_numpy(whole.decode(), disallowed_special=()).astype(np.int64)
                out.append((a, np.array(b, dtype=np.int64)))
            else:
                out.append((none, none))
        return out

    def totals(self, texts: list[str]) -> list[tuple]:
        """For each text n_a, n_b, groups, links, digest, different pairs and their times.

        Each text is aligned by itself; what follows from it is made for all at once.
        """
        made = self.encode(texts)
        a, b = (np.concatenate([x[side] for x in made]) for side in (0, 1))
        a_row, b_row = (np.cumsum([0, *(len(x[side]) for x in made)]) for side in (0, 1))
        a_ends, b_ends = np.cumsum(self._a_size[a]), np.cumsum(self._b_size[b])
        a_to, b_to = [], []
        for row in range(len(texts)):
            # A text's own offsets are small numbers, and so are its dictionaries.
            start = a_ends[a_row[row] - 1] if a_row[row] else 0
            found = common_ends(
                (a_ends[a_row[row]:a_row[row + 1]] - start).tolist(), (b_ends[b_row[row]:b_row[row + 1]] - start).tolist()
            )
            a_to.append(np.array(found[0], dtype=np.int64) + (a_row[row] + 1))
            b_to.append(np.array(found[1], dtype=np.int64) + (b_row[row] + 1))
        groups = np.cumsum([0, *map(len, a_to)])
        a_to, b_to = np.concatenate(a_to), np.concatenate(b_to)
        a_from, b_from = (np.concatenate([[0], x[:-1]]) for x in (a_to, b_to))
        a_many, b_many = a_to - a_from, b_to - b_from
        a_link, b_link = linked_tokens(a_ends, b_ends)
        # A group's ids stand after all ids of both sides in groups before, those of a first.
        text = np.empty(len(a) + len(b), dtype=object)
        last = np.zeros(len(a), dtype=np.int64)
        last[a_to - 1] = len(self._a_bytes)
        text[np.arange(len(a)) + np.repeat(b_from, a_many)] = self._a_text[a + last]
        last = np.zeros(len(b), dtype=np.int64)
        last[b_to - 1] = len(self._b_bytes)
        text[np.arange(len(b)) + np.repeat(a_to, b_many)] = self._b_text[b + last]
        links = a[a_link] << 32 | b[b_link]
        link_row = np.searchsorted(a_link, a_row)
        out = []
        for row in range(len(texts)):
            if a_row[row] == a_row[row + 1]:
                out.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            spelled = "".join(text[a_row[row] + b_row[row]:a_row[row + 1] + b_row[row + 1]].tolist())
            own = links[link_row[row]:link_row[row + 1]]
            out.append((
                int(a_row[row + 1] - a_row[row]), int(b_row[row + 1] - b_row[row]), int(groups[row + 1] - groups[row]),
                len(own), hashlib.sha256(spelled[:-1].encode()).hexdigest(), *np.unique(own, return_counts=True),
            ))
        return out


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    """The tokenizers of a worker, read once."""
    if (a_path, b_path) not in _TOKENIZERS:
        _TOKENIZERS[a_path, b_path] = Tokenizers(a_path, b_path)
    return _TOKENIZERS[a_path, b_path]


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of every row of ``docs``.

    A pair is a * 2^32 + b; ``times`` has how often each of the different pairs is linked.
    """
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(a_path, b_path)
        for batch in stream:
            column, held, chars, start = batch.column(2), [], 0, 0
            for row in range(len(column)):
                held.append(column[row].as_py() or "")
                chars += len(held[-1])
                if chars < SLICE_CHARS and row + 1 < len(column):
                    continue
                *numbers, digests, pairs, times = zip(*both.totals(held), strict=True)
                ends = np.cumsum([0, *(len(x) for x in pairs)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(held)), batch.column(1).slice(start, len(held)),
                     *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()),
                     *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x)))
                       for x in (pairs, times))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                held, chars, start = [], 0, row + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text"))
    return numbered.mapInArrow(
        batches, f"row bigint, doc_id {kind}, {_COUNTS}, pairs array<bigint>, times array<bigint>"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, documents (that hold it linked), best (whether no pair of its first id has more)."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("documents")
    )
    # An id has at most as many pairs as the other vocabulary has entries.
    of_first = Window.partitionBy(F.shiftright("pair", 32))
    return counted.withColumn("best", F.col("documents") == F.max("documents").over(of_first))


def _shipped(counts: DataFrame, most: int) -> tuple[int, bool]:
    """The least class of counts that is shipped, and whether any pair is left."""
    classes = sorted(counts.groupBy("class").count().collect(), reverse=True)  # bounded by CLASSES
    least, total = 1 << 30, 0
    for number, pairs in classes:
        total += pairs
        if total > most:
            return least, True
        least = number
    return least, False


def align_corpus(docs: DataFrame, a_path: str, b_path: str, shipped: int = SHIPPED_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    aligned_texts(docs, a_path, b_path).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    counts = cut_lineage(
        pair_counts(aligned).withColumn("class", F.floor(F.log2("documents") * CLASSES).cast("int"))
    )
    least, some_left = _shipped(counts, shipped)
    common = counts.where(F.col("class") >= least).orderBy("pair").toPandas()
    table = spark.sparkContext.broadcast(
        tuple(common[name].to_numpy() for name in ("pair", "documents", "best"))
    )

    def weigh(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, documents, best = table.value
        for batch in stream:
            pairs, times = (batch.column(batch.schema.get_field_index(x)) for x in ("pairs", "times"))
            ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            pair, time = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
            count, top = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            count[known], top[known] = documents[at[known]], best[at[known]]
            sums = [np.diff(np.concatenate([[0], np.cumsum(time * x)])[ends]) for x in (top, count)]
            left = np.concatenate([[0], np.cumsum(~known)])[ends]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], *(pa.array(x) for x in sums),
                 *(pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~known])) for x in (pair, time))],
                names=[*batch.schema.names[:7], "n_best", "count_sum", "pairs", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = aligned.mapInArrow(
        weigh, f"row bigint, doc_id {kind}, {_COUNTS}, n_best bigint, count_sum bigint, "
        "pairs array<bigint>, times array<bigint>",
    )
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not some_left:
        return weighed.select(*names)
    rest = weighed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.*")
    added = rest.withColumnRenamed("pairs", "pair").join(
        counts.where(F.col("class") < least).drop("class"), "pair"
    ).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("documents")).alias("more_sum"),
    )
    return weighed.drop("pairs", "times").join(added, "row", "left").select(
        *names[:5], (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
