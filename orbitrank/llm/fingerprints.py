"""Fingerprints of documents from their improbable byte windows.

Every window of 32 bytes has an entropy. How often each class of entropies occurs in
the whole corpus ranks the windows: the rarer, the better. A window that has the best
rank of the 32 windows around it often enough is a feature. Features go, in their order,
into a chain of Bloom filters of 2,048 bits, 160 to a filter. Two fingerprints are as
alike as the filters of the shorter chain find their bits in the other, beyond what
chance gives and relative to the most there could be.

Windows are found block by block with integer sums, so a text has the same fingerprint
wherever it stands and however long it is. Defined results: null text is empty; an empty
text has an empty fingerprint, which is like another empty one (1) and unlike all
others (0); a text under 32 bytes is one feature, padded; windows of very low entropy
are no features, so a text that has no others, as of one repeated letter, is one feature
as a whole, by its digest, and only like itself. Of rows
with one id the one with the lower text hash comes first; rows without an id come last.
Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrank.llm.arrays import mix64, row_slices, utf8

WINDOW = 32
#: Windows among which the best is sought, and how often it has to be the best.
FRAME, POPULARITY = 32, 8
#: Classes of entropy from 0 to the highest, and the first whose windows count.
CLASSES, FIRST_CLASS = 1001, 100
FILTER_BITS, FILTER_FEATURES, BITS_PER_FEATURE = 2048, 160, 5
BLOCK = 1 << 16
#: Characters of text that are fingerprinted together.
SLICE_CHARS = 1 << 20
#: Documents aimed at in one range of ids, and the most ranges.
ROWS_PER_RANGE, MOST_RANGES = 256, 10_000
_NEVER = CLASSES

# Sum over byte values of count * log2(count) as whole numbers: what one more adds.
_SCALE = 1 << 20
_TERMS = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], dtype=np.int64)
_STEP = np.concatenate([[0], np.diff(_TERMS)])


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Entropy class of the window that begins at each place of ``data``."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    after = np.ones(n, dtype=np.uint8)  # equal bytes in the window from here on
    before = np.ones(n, dtype=np.uint8)  # equal bytes in the window up to here
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        after[:-lag] += same
        before[lag:] += same
    first = _TERMS[np.bincount(data[:WINDOW], minlength=256)].sum()
    sums = np.empty(n - WINDOW + 1, dtype=np.int64)
    sums[0] = first
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[after[:n - WINDOW]], out=sums[1:])
    sums[1:] += first
    return (_TERMS[WINDOW] - sums) * (CLASSES - 1) // _TERMS[WINDOW]


def _blocks(n: int, overlap: int) -> Iterator[tuple[int, int]]:
    for start in range(0, max(n - overlap, 0), BLOCK):
        yield start, min(start + BLOCK, n - overlap)


def count_classes(docs: DataFrame) -> np.ndarray:
    """How many windows of all whole texts are in each entropy class."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(CLASSES, dtype=np.int64)
        for batch in stream:
            data, offsets = utf8(batch.column(0))
            inside = _within(offsets, len(data), WINDOW)
            for start, stop in _blocks(len(data), WINDOW - 1):
                found = entropy_classes(data[start:stop + WINDOW - 1])
                totals += np.bincount(found[inside[start:stop]], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES)), pa.array(totals)], names=["class", "n"]
        )

    counted = docs.select("text").mapInArrow(batches, "class bigint, n bigint").groupBy("class").agg(
        F.sum("n").alias("n")
    )
    totals = np.zeros(CLASSES, dtype=np.int64)
    for number, n in counted.collect():  # a row for each class
        totals[number] = n
    return totals


def class_ranks(totals: np.ndarray) -> np.ndarray:
    """Rank of each class, the rarest first; classes of low entropy have none."""
    ranks = np.empty(CLASSES, dtype=np.int64)
    ranks[np.argsort(totals, kind="stable")] = np.arange(CLASSES)
    ranks[:FIRST_CLASS] = _NEVER
    return ranks


def _within(offsets: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether ``width`` bytes from each place on are of one text."""
    marks = np.zeros(n + 1, dtype=np.int64)
    begins, ends = offsets[:-1], offsets[1:] - width + 1
    long = ends > begins
    np.add.at(marks, begins[long], 1)
    np.add.at(marks, ends[long], -1)
    return np.cumsum(marks[:n]) > 0


def _best_in_frames(classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Place of the first best window of the frame from each place on."""
    keys = (ranks[classes] << 32) | np.arange(len(classes))
    width = 1
    while width < FRAME:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return keys & 0xFFFFFFFF


def feature_places(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where the features of the concatenated texts begin, ascending.

    Texts with fewer windows than a frame have one frame.
    """
    overlap = WINDOW + FRAME - 2
    inside = _within(offsets, len(data), overlap + 1)
    places, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start, stop in _blocks(len(data), overlap):
        valid = inside[start:stop]
        if not valid.any():
            continue
        classes = entropy_classes(data[start:stop + overlap])
        best = _best_in_frames(classes, ranks)[valid]
        best = best[ranks[classes[best]] != _NEVER] + start
        if len(best):
            heads = np.flatnonzero(np.diff(best, prepend=-1))
            places.append(best[heads])
            counts.append(np.diff(heads, append=len(best)))
    found, numbers = np.unique(np.concatenate(places), return_inverse=True)
    popular = found[np.bincount(numbers, weights=np.concatenate(counts), minlength=len(found)) >= POPULARITY]
    lengths = np.diff(offsets)
    single = []
    for text in np.flatnonzero((lengths >= WINDOW) & (lengths <= overlap)):
        rank = ranks[entropy_classes(data[offsets[text]:offsets[text + 1]])]
        if rank.min() != _NEVER:
            single.append(offsets[text] + int(rank.argmin()))
    return np.sort(np.concatenate([popular, np.array(single, dtype=np.int64)]))


def _feature_hashes(windows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of a window's bytes."""
    words = np.ascontiguousarray(windows).view("<u8")
    hashes = np.full(len(words), 0x243F6A8885A308D3, dtype=np.uint64)
    for column in range(words.shape[1]):
        hashes = mix64(hashes ^ words[:, column])
    return hashes


def _filters(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters of a text's features, a row of bytes for each."""
    chain = np.arange(len(hashes)) // FILTER_FEATURES
    bits = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), dtype=bool)
    for part in range(BITS_PER_FEATURE):
        place = (hashes >> np.uint64(11 * part)) & np.uint64(FILTER_BITS - 1)
        bits[chain, place.astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Chain of filters of every text."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    places = feature_places(data, offsets, ranks)
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places] if len(places) else (
        np.zeros((0, WINDOW), dtype=np.uint8)
    )
    hashes = _feature_hashes(windows)
    bounds = np.searchsorted(places, offsets)
    out = []
    for text, (first, last) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own = hashes[first:last]
        if 0 < lengths[text] < WINDOW:
            padded = np.frombuffer(texts[text].ljust(WINDOW, b"\0"), dtype=np.uint8)
            own = _feature_hashes(padded[None, :])
        elif lengths[text] and not len(own):  # nothing but windows of low entropy
            digest = np.frombuffer(hashlib.sha256(texts[text]).digest(), dtype=np.uint8)
            own = _feature_hashes(digest[None, :])
        out.append(_filters(own))
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Normalised overlap of two chains of filters, from 0 to 1."""
    if one.shape == two.shape and (one == two).all():
        return 1.0
    if not len(one) or not len(two):
        return 0.0
    # The sparser chain asks; of two alike the first by its bytes, so that order is no matter.
    if (len(one), one.tobytes()) > (len(two), two.tobytes()):
        one, two = two, one
    other = np.unpackbits(two, axis=1).astype(np.float32)
    n_other = other.sum(axis=1)
    total = weights = 0.0
    for start in range(0, len(one), 256):
        asked = np.unpackbits(one[start:start + 256], axis=1).astype(np.float32)
        n_asked = asked.sum(axis=1)
        common = asked @ other.T
        chance = n_asked[:, None] * n_other[None, :] / FILTER_BITS
        most = np.minimum(n_asked[:, None], n_other[None, :])
        share = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0)
        total += float((share.max(axis=1) * n_asked).sum())
        weights += float(n_asked.sum())
    return total / weights


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _described(ids: list, texts: list[str], ranks: np.ndarray) -> pa.RecordBatch:
    """Rows of all texts but the last, which is only the one after."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    encoded = [x.encode("utf-8", "replace") for x in changed]
    made = fingerprints([x.encode("utf-8", "replace") for x in texts] + encoded, ranks)
    own, other = made[:len(texts)], made[len(texts):]
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array([len(x) for x in texts[:n]], pa.int64()),
         pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
         pa.array([own[i].tobytes().hex() for i in range(n)], pa.string()),
         pa.array([other[i].tobytes().hex() for i in range(n)], pa.string()),
         pa.array([likeness(own[i], other[i]) for i in range(n)], pa.float64()),
         pa.array([likeness(own[i], own[i + 1]) for i in range(n)], pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
               "near_edited", "near_next"],
    )


def _id_bounds(docs: DataFrame) -> list[int]:
    """Ids that end ranges of about equally many documents; the last is the highest id."""
    n, highest = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    if not n:
        return []
    ranges = int(min(MOST_RANGES, -(-n // ROWS_PER_RANGE)))
    if ranges == 1:
        return [highest]
    shares = [i / ranges for i in range(1, ranges)]
    inner = docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0]
    return sorted({*inner, highest})


def with_following(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Fingerprint every text, and an edit of it with the next document's beginning.

    Documents follow each other by descending id, and after the last comes the first.
    They are dealt out by ranges of ids; a document with the highest id of a range is
    dealt a second time, to the range above, whose last document it follows. Texts are
    compressed on their way.
    """
    bounds = np.array(_id_bounds(docs), dtype=np.int64)
    last_range = max(len(bounds) - 1, 0)

    def dealt(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in stream:
            missing = np.array(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            at = np.where(missing, 0, np.searchsorted(bounds, ids))
            data, offsets = utf8(batch.column(2))
            for start, stop in row_slices(offsets):
                rows = np.arange(start, stop)
                packed = [press.compress(data[offsets[i]:offsets[i + 1]].tobytes()) for i in rows]
                tops = [i for i in rows if len(bounds) and not missing[i] and ids[i] == bounds[at[i]]]
                if not len(bounds):  # no id at all: what follows the last is any of them
                    tops = list(rows)
                both = [*rows, *tops]
                to = np.concatenate([at[start:stop], [(at[i] + 1) % (last_range + 1) for i in tops]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int64)), pa.array([False] * len(rows) + [True] * len(tops)),
                     batch.column(0).take(pa.array(both)), batch.column(1).take(pa.array(both)),
                     pa.array(packed + [packed[i - start] for i in tops], pa.binary())],
                    names=["range", "above", "doc_id", "tie", "packed"],
                )

    def described(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        at, ended, ids, texts, chars = None, True, [], [], 0
        for batch in stream:
            for row in range(len(batch)):
                to, above, doc_id = (batch.column(i)[row].as_py() for i in (0, 1, 2))
                if to != at:
                    at, ended, ids, texts, chars = to, False, [], [], 0
                if ended:
                    continue
                texts.append(unpack.decompress(batch.column(4)[row].as_py()).decode("utf-8", "replace"))
                chars += len(texts[-1])
                if not above:
                    ids.append(doc_id)
                if above or chars >= SLICE_CHARS and len(texts) > 1:
                    kept = ids if above else ids[:-1]
                    if kept:
                        yield _described(kept, texts, ranks)
                    ended = above
                    ids, texts = ids[len(kept):], texts[-1:]
                    chars = len(texts[0])

    narrow = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    spread = narrow.mapInArrow(
        dealt, "range bigint, above boolean, doc_id bigint, tie bigint, packed binary"
    ).repartition("range").sortWithinPartitions(
        "range", "above", F.col("doc_id").desc_nulls_last(), "tie"
    )
    return spread.mapInArrow(
        described, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def fingerprint_corpus(docs: DataFrame) -> DataFrame:
    """Rank entropies over all of ``docs``, then fingerprint every document and its edit."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return with_following(docs, class_ranks(count_classes(docs)))
