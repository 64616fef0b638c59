"""Fill-in-middle transformation by secondary sort, and its exact restoration.

1. A text of n units (code points) is cut in three by its document's digest. Each part
   is emitted in pieces of at most ``PIECE_UNITS`` units, keyed by row and by the place
   that the piece has in the output. A row's first piece carries what is known of it.
2. Rows are dealt out by key and sorted by (key, place), so a task streams each output
   piece by piece into a digest and holds one piece at a time, however long the text.
3. The same stream is parsed by the markers alone: each stretch between two markers
   becomes a piece keyed by row and by the place it has in the text. The tasks sort
   again, without another shuffle, and stream the restored text into its digest.

A key is a row's own number, so the rows of a hot or missing id are dealt out like all
others. It is made by the scan that emits the pieces, which gives the same numbers when
a lost task is run again.

Defined results: null text is empty; an empty text and one that holds a marker are
plain; a missing doc_id is digested as no digits; repeated rows are transformed each.
Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units in one piece.
PIECE_UNITS = 1 << 14
#: Bytes of pieces that are handed on together.
BATCH_BYTES = 1 << 22
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: The order of the parts in the output of each form.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The order of the parts in the text.
IN_TEXT = (PREFIX, MIDDLE, SUFFIX)
#: Places that a part of a restored text leaves for its pieces.
_PART = 1 << 40


@dataclass(frozen=True)
class Cut:
    """Where a text is cut and how it is put together."""

    n: int
    form: str
    first: int
    second: int

    def parts(self, text: str) -> list[tuple[str, str]]:
        """Marker and part of the text, in the order of the output."""
        if self.form == "plain":
            return [("", text)]
        found = {PREFIX: text[:self.first], MIDDLE: text[self.first:self.second], SUFFIX: text[self.second:]}
        return [(marker, found[marker]) for marker in ORDERS[self.form]]


def cut(doc_id: object, text: str, plain_from: int = 90, spm_under: int = 20) -> Cut:
    """The cut that a document's digest chooses."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[at:at + 8], 16) for at in (0, 8, 16, 24))
    n = len(text)
    one, two = h1 % (n + 1), h2 % (n + 1)
    if not text or h3 % 100 >= plain_from or any(marker in text for marker in MARKERS):
        form = "plain"
    else:
        form = "spm" if h4 % 100 < spm_under else "psm"
    return Cut(n, form, min(one, two), max(one, two))


def pieces(chosen: Cut, text: str) -> Iterator[bytes]:
    """The output of a text in order, each part's marker before its first piece."""
    for marker, part in chosen.parts(text):
        yield (marker + part[:PIECE_UNITS]).encode("utf-8", "replace")
        for at in range(PIECE_UNITS, len(part), PIECE_UNITS):
            yield part[at:at + PIECE_UNITS].encode("utf-8", "replace")


class Parser:
    """Finds the parts in an output that is fed piece by piece, however it is cut."""

    def __init__(self, form: str) -> None:
        self._markers = [marker.encode() for marker in ORDERS.get(form, ())]
        self._ranks = [IN_TEXT.index(marker) for marker in ORDERS.get(form, ())]
        self._reached, self._count, self._held = 0, 0, b""

    def _place(self) -> int:
        self._count += 1
        rank = self._ranks[self._reached - 1] if self._reached else 0
        return rank * _PART + self._count

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        """Place in the text and bytes of what is certain so far."""
        data = self._held + data
        while self._reached < len(self._markers):
            marker = self._markers[self._reached]
            at = data.find(marker)
            if at < 0:
                break
            if at:
                yield self._place(), data[:at]
            data = data[at + len(marker):]
            self._reached += 1
        # A marker may begin at the end of what is known.
        keep = 0 if last or self._reached == len(self._markers) else len(MIDDLE) - 1
        done, self._held = data[:len(data) - keep], data[len(data) - keep:] if keep else b""
        if done:
            yield self._place(), done


_TEXT_PIECE = "row bigint, place bigint, piece binary"


def _facts(kind: str) -> str:
    return f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint"


class _Batches:
    """Gathers rows until their pieces fill a batch."""

    def __init__(self, schema: pa.Schema) -> None:
        self._schema, self._rows, self._bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self._rows.append(row)
        self._bytes += size + 64
        if self._bytes >= BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._rows:
            columns = [pa.array(x, f.type) for x, f in zip(zip(*self._rows, strict=True), self._schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self._schema)
            self._rows, self._bytes = [], 0


def _schema(kind: pa.DataType, *, output: bool = False) -> pa.Schema:
    fields = [("row", pa.int64()), ("place", pa.int64()), ("piece", pa.binary()), ("doc_id", kind), ("n", pa.int64()),
              ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    return pa.schema([*fields, ("output_sha256", pa.string())] if output else fields)


def assembly(docs: DataFrame, plain_from: int = 90, spm_under: int = 20) -> DataFrame:
    """The output of every row of ``docs`` in pieces, sorted by (row, place) in each partition.

    row, place, piece (UTF-8) and, in a row's first piece alone, doc_id, n, form,
    prefix_chars and middle_chars. All pieces of a row are in one partition.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in stream:
            made = made or _Batches(_schema(batch.column(1).type))
            ids = batch.column(1).to_pylist()
            for at, row in enumerate(batch.column(0).to_pylist()):
                text = batch.column(2)[at].as_py() or ""
                chosen = cut(ids[at], text, plain_from, spm_under)
                whole = chosen.form == "plain"
                known = (
                    ids[at], chosen.n, chosen.form, None if whole else chosen.first,
                    None if whole else chosen.second - chosen.first,
                )
                for place, piece in enumerate(pieces(chosen, text)):
                    yield from made.add((row, place, piece, *(known if not place else (None,) * 5)), len(piece))
        if made:
            yield from made.rest()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text"))
    emitted = numbered.mapInArrow(emit, f"{_TEXT_PIECE}, {_facts(kind)}")
    return emitted.repartition("row").sortWithinPartitions("row", "place")


def restoration(assembled: DataFrame) -> DataFrame:
    """The texts of ``assembly``'s output in pieces, sorted by (row, place) in each partition.

    A row's first piece, of place -1 and without bytes, carries its facts and the digest
    of its output. Nothing but output and form is used to rebuild the text.
    """
    kind = assembled.schema["doc_id"].dataType.simpleString()

    def parse(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, known, digest, parser = None, None, None, None, None

        def finish() -> Iterator[pa.RecordBatch]:
            for place, piece in parser.feed(b"", last=True):
                yield from made.add((now, place, piece, *(None,) * 6), len(piece))
            yield from made.add((now, -1, b"", *known, digest.hexdigest()), 0)

        for batch in stream:
            made = made or _Batches(_schema(batch.column(3).type, output=True))
            facts = zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True)
            for at, (row, fact) in enumerate(zip(batch.column(0).to_pylist(), facts, strict=True)):
                if row != now:
                    if now is not None:
                        yield from finish()
                    now, known, digest, parser = row, fact, hashlib.sha256(), Parser(fact[2])
                data = batch.column(2)[at].as_py()
                digest.update(data)
                for place, piece in parser.feed(data):
                    yield from made.add((row, place, piece, *(None,) * 6), len(piece))
        if now is not None:
            yield from finish()
            yield from made.rest()

    return assembled.mapInArrow(
        parse, f"{_TEXT_PIECE}, {_facts(kind)}, output_sha256 string"
    ).sortWithinPartitions("row", "place")


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_under: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, restored = None, [], None
        for batch in stream:
            fields = [*list(batch.schema)[3:], pa.field("restored_sha256", pa.string())]
            facts = zip(*(batch.column(i).to_pylist() for i in range(3, 9)), strict=True)
            for at, (row, fact) in enumerate(zip(batch.column(0).to_pylist(), facts, strict=True)):
                if row != now:
                    if now is not None:
                        rows.append((*known, restored.hexdigest()))
                    now, known, restored = row, fact, hashlib.sha256()
                restored.update(batch.column(2)[at].as_py())
            if rows:
                yield _rows(rows, fields)
                rows = []
        if now is not None:
            yield _rows([(*known, restored.hexdigest())], fields)

    return restoration(assembly(docs, plain_from, spm_under)).mapInArrow(
        digest, f"{_facts(kind)}, output_sha256 string, restored_sha256 string"
    )


def _rows(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])


#: The same by definition; units are the characters of DuckDB's strings.
FILL_SQL = """
WITH digested AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS one,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS two,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4
  FROM digested
), formed AS (
  SELECT doc_id, text, n, least(one, two) AS first, greatest(one, two) AS second,
         CASE WHEN text = '' OR h3 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
              THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), cut AS (
  SELECT *, substr(text, 1, first) AS prefix, substr(text, first + 1, second - first) AS middle,
         substr(text, second + 1) AS suffix
  FROM formed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN first END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN second - first END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""
