"""Byte-pair encoding in linear time by backtracking, and decoding from an offset table.

A sequence of tokens is what merging would give exactly when every token is made of its
own merges and no merge would have joined two neighbours before their own merges did.
The encoder walks a word from the left with the longest token that an Aho-Corasick
automaton finds at each place. Where it does not go with the token before it, the next
shorter token that is a prefix is tried, and where there is none the last token is given
back. Each place is left at most once, so a word takes linear time. Whether two tokens
go together is kept in a table that grows with the pairs that were met.

Decoding puts a blank between the tokens' strings, as a tokenizer without a decoder does;
it copies bytes from one blob by an offset table.

Defined results: null and empty texts have no tokens and decode to an empty text; added
special tokens are found in raw text; repeated rows are encoded each. Columns other than
doc_id and text are not read, whatever their names. Texts are worked on in slices of
bounded size, one longer text by itself.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks the end of a word in the automaton's strings, which else hold byte values.
END = "Ā"
WORD_END = "</w>"
#: Raw words whose tokens a worker keeps; beyond, it begins anew. Longer ones are not kept.
KEPT_WORDS = 400_000
KEPT_LENGTH = 64
#: Characters of text that are encoded before their tokens are handed on.
SLICE_CHARS = 1 << 21
#: White space as the tokenizer's pattern has it (fixed value).
_BLANK = "\t-\r \x85\xa0  -     　"
#: Splits a word into the units that merges never leave (fixed value).
_UNITS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")
_BLANKS = regex.compile(f"[{_BLANK}]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte, to that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairs:
    """Tables of one tokenizer file, built once in each Python worker."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary: dict[str, int] = described["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self._rank = [-1] * size
        self._halves: list[tuple[int, int] | None] = [None] * size
        self._merge: dict[int, int] = {}
        for rank, (left, right) in enumerate(described["model"]["merges"]):
            a, b, made = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if self._halves[made] is not None or max(self._rank[a], self._rank[b]) >= rank:
                raise ValueError("merges must make each token once, from tokens made before")
            self._rank[made], self._halves[made] = rank, (a, b)
            self._merge[a << 20 | b] = rank
        self._compatible: dict[int, bool] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}

        as_bytes = byte_symbols()
        self._length = [0] * size
        strings: dict[str, int] = {}
        whole: list[bool] = [True] * size
        for token, number in sorted(vocabulary.items(), key=lambda x: self._rank[x[1]]):
            halves = self._halves[number]
            if halves is not None:
                whole[number] = (
                    whole[halves[0]] and whole[halves[1]] and not self._joined_early(*halves, self._rank[number])
                )
            ending = token.endswith(WORD_END)
            body = token[: -len(WORD_END)] if ending else token
            string = "".join(chr(as_bytes[c]) for c in body) + END * ending
            self._length[number] = len(string)
            if whole[number]:
                strings[string] = number
        self._shorter = [-1] * size
        self._automaton = ahocorasick.Automaton()
        for string, number in strings.items():
            self._automaton.add_word(string, number)
            for cut in range(len(string) - 1, 0, -1):
                if (found := strings.get(string[:cut], -1)) >= 0:
                    self._shorter[number] = found
                    break
        self._automaton.make_automaton()

        spelled = {number: token for token, number in [*vocabulary.items(), *self.special.items()]}
        pieces = [(spelled.get(i, "") + " ").encode() for i in range(size)]
        self._blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self._offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        self._find_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._kept: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens on one edge of a token: each with its own rank and its parent's."""
        kept = self._right if side else self._left
        if token not in kept:
            made, consumed = [], 1 << 60
            at = token
            while True:
                made.append((at, self._rank[at], consumed))
                if self._halves[at] is None:
                    break
                consumed = self._rank[at]
                at = self._halves[at][side]
            kept[token] = made
        return kept[token]

    def _joined_early(self, one: int, two: int, before: int) -> bool:
        """Whether a merge of rank under ``before`` joins parts of two neighbours.

        It does if both parts exist by then and neither has been used for its own token;
        of two merges of equal rank the left one comes first.
        """
        merge = self._merge
        for x, x_made, x_used in self._spine(one, 1):
            for y, y_made, y_used in self._spine(two, 0):
                rank = merge.get(x << 20 | y, -1)
                if rank >= 0 and rank < before and x_made < rank < x_used and y_made < rank <= y_used:
                    return True
        return False

    def compatible(self, one: int, two: int) -> bool:
        """Whether two tokens stay apart when they are neighbours."""
        key = one << 20 | two
        known = self._compatible.get(key)
        if known is None:
            known = self._compatible[key] = not self._joined_early(one, two, 1 << 60)
        return known

    def encode_unit(self, unit: str) -> list[int]:
        """Tokens of one unit, which no merge leaves."""
        string = unit.encode("utf-8", "replace").decode("latin-1") + END
        n, length, shorter = len(string), self._length, self._shorter
        longest = [-1] * n
        for last, token in self._automaton.iter(string):
            longest[last + 1 - length[token]] = token
        open_at = bytearray(b"\1") * (n + 1)
        open_at[n - 1] = 0  # the end mark is part of the last token
        tokens: list[int] = []
        place, token = 0, longest[0]
        while place < n:
            after = place + length[token]
            if open_at[after] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                place = after
                token = longest[place] if place < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[place] = 0
                token = tokens.pop()
                place -= length[token]
        return tokens

    def _encode_plain(self, word: str) -> list[int]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        out: list[int] = []
        for unit in _UNITS.findall(word.lower()):
            out += self.encode_unit(unit)
        return out

    def _encode_word(self, word: str) -> bytes:
        if "<|" in word:
            ids: list[int] = []
            for part in self._find_special.split(word):
                ids += [self.special[part]] if part in self.special else self._encode_plain(part)
        else:
            ids = self._encode_plain(word)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token numbers of a text as little-endian unsigned 32-bit integers."""
        if _SEPARATORS.search(text):  # these end a word for str.split alone
            words = [x for x in _BLANKS.split(text) if x]
        else:
            words = text.split()
        kept = self._kept
        new = {word for word in words if word not in kept}
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = set(words)
        made = {word: self._encode_word(word) for word in new}
        long = {word: ids for word, ids in made.items() if len(word) > KEPT_LENGTH}
        kept.update(made)
        out = b"".join(map(kept.__getitem__, words))
        for word in long:
            del kept[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of encoded tokens."""
        numbers = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(numbers):
            return b""
        begins = self._offsets[numbers]
        lengths = self._offsets[numbers + 1] - begins
        heads = np.cumsum(lengths) - lengths
        source = np.repeat(begins - heads, lengths)
        source += np.arange(len(source))
        return self._blob[source].tobytes()[:-1]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BytePairs:
    """The tables of a file, once in each worker."""
    return BytePairs(path)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text of every row."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tokenizer(tokenizer_path)
        for batch in stream:
            start, chars, ids = 0, 0, []
            column = batch.column(1)
            for row in range(len(column)):
                text = column[row].as_py() or ""
                ids.append(tables.encode(text))
                chars += len(text)
                if chars >= SLICE_CHARS or row + 1 == len(column):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(ids)), pa.array(ids, pa.binary()),
                         pa.array([tables.decode(x) for x in ids], pa.binary())],
                        names=["doc_id", "ids", "decoded"],
                    )
                    start, chars, ids = row + 1, 0, []

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, ids binary, decoded binary")
    return made.withColumn("decoded", F.col("decoded").cast("string"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode_decode`` gives."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
