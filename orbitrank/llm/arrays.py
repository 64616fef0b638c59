"""Array helpers for Arrow batches of texts: slices of bounded size, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
_POWERS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)

with np.errstate(over="ignore"):
    _POWER = np.multiply.accumulate(np.full(SLICE_BYTES, _BASE, dtype=np.uint64))
    #: What takes a word's powers back to those of a word at the beginning of its slice.
    _BACK = np.multiply.accumulate(np.full(SLICE_BYTES, pow(int(_BASE), -1, 1 << 64), dtype=np.uint64)) * _BASE


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and leaves every other byte."""
    return data + (data - np.uint8(65) < 26).view(np.uint8) * np.uint8(32)


def in_words(data: np.ndarray) -> np.ndarray:
    """Whether each byte is of a word: all but space and 0x09 to 0x0D."""
    return (data != 32) & (data - np.uint8(9) > 4)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, null as empty, and where each text begins and ends."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32) if ends else np.zeros(1)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``most`` bytes, or one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def word_edges(data: np.ndarray, offsets: np.ndarray):
    """Begin and end of every word, and the number of words before each text."""
    inside = in_words(data)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A word never runs over the border between two texts.
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of every word of lower-cased bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = stops - starts
    with np.errstate(over="ignore"):
        if len(data) <= SLICE_BYTES and int(lengths.max()) <= _POWERS:
            # Powers run on over the slice and are taken back to each word's beginning.
            terms = ((data.astype(np.uint16) + np.uint16(1)) * in_words(data)).astype(np.uint64)
            terms *= _POWER[:len(data)]
            before = terms.cumsum()
            sums = (before[stops - 1] - before[starts] + terms[starts]) * _BACK[starts]
        else:
            # Place of each byte in its word, over the bytes of words alone.
            heads = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(heads, lengths)
            source = place + np.repeat(starts, lengths)
            terms = (data[source].astype(np.uint64) + np.uint64(1)) * _POWER[place & (_POWERS - 1)]
            sums = np.add.reduceat(terms, heads)
        return mix64(sums ^ (lengths.astype(np.uint64) * _BASE))


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first and last row, word hashes, words before each row, word tails.

    A tail is the number made of a word's last three bytes.
    """
    data, offsets = utf8(column)
    for start, stop in row_slices(offsets):
        part = lowered(data[offsets[start]:offsets[stop]])
        starts, stops, first = word_edges(part, offsets[start:stop + 1] - offsets[start])
        tails = np.zeros(len(starts), dtype=np.int64)
        for back in range(1, 4):
            tails *= 256
            tails += part.take(stops - back, mode="clip") * (stops - starts >= back)
        yield start, stop, word_hashes(part, starts, stops), first, tails
