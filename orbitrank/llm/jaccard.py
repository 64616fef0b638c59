"""Jaccard self-join on word shingles, exact, in tiles of bounded size.

1. Every document becomes the set of hashes of its shingles. Equal sets are one set from
   here on, whatever the number of copies.
2. From ``PARTED`` per cent on, a set is cut by ranges of its hashes into parts: as many as
   shingles may be in only one of two linked sets of such sizes, and m more. So m parts at
   least are the same in both. Each part as a whole is a key, but for the m - 1 that hold
   least, as one shared key must remain. Single shingles, which more sets share by chance
   the more sets there are, bring nobody together.
   Below, where parts would be as small as shingles, a set's keys are its first shingles in
   the order of their hashes: as many as may be
   missing from a partner, and m more. Linked sets share at least m keys. A set that
   shares fewer with all other sets together has no links and is done. Of the others'
   keys the m - 1 that most sets share are left out. So
   common passages bring nobody together.
3. Sets that share a key that is left and whose sizes allow a link are chained, and the
   chains' connected components are families: no link leaves a family.
4. A family's sets are sorted by size and cut into tiles. Tiles whose sizes allow a link
   meet in one task. There hashed bitmap signatures bound the intersection of two sets
   from above by counting bits, and what is left is intersected as sorted arrays.
5. A meeting gives, for each of its sets that links, how many documents it links with
   and the least set that its links reach there. The connected components of these are
   the classes.

No step holds more than two tiles, and no step gives the pairs of a group: what leaves a
meeting is at most a row for each of its sets.

Defined results: null and empty texts and texts without words have an empty set, no
links and a class of their own; a text with fewer words than a shingle is one shingle of
all its words; repeated ids and rows are told apart by nothing, so rows of one id share
the class of that id's lowest link; a null id never names a class unless the class has
no other. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrank.llm.arrays import hashed_words, mix64
from orbitrank.llm.components import connected
from orbitrank.session import cut_lineage

#: Shingles aimed at in a tile, and shingles that a set counts for beside its own.
TILE_SHINGLES, SET_SHINGLES = 1 << 20, 1 << 10
#: Bits of a signature.
SIGNATURE_BITS = 2_048
#: One shared key more is asked for with so many shingles that may be missing.
SPARE = 3
#: Sets that link from so many per cent on are cut into parts.
PARTED = 85
#: One part more is left out with so many shingles that only one of two sets may have.
SPARE_PARTS = 6
#: Sizes from one of these numbers up to the next are cut into as many parts.
RUNGS = np.unique(np.floor(1.5 ** np.arange(80)).astype(np.int64))
#: Rounds that take out sets which share too little with those that are left.
PRUNING = 2
#: Rows whose sets are made at once.
SET_ROWS = 512
#: Up to this many rows that name a set's document are shipped; more are joined.
SHIPPED_GIVERS = 200_000


@dataclass(frozen=True)
class Likeness:
    """Links need ``per_cent`` * union <= 100 * intersection, over shingles of ``words``."""

    words: int
    per_cent: int

    def least_common(self, one, two):
        """Fewest common shingles with which two sets of these sizes link."""
        return -(-self.per_cent * (one + two) // (100 + self.per_cent))

    def prefix(self, size):
        """Keys of a set, and how many of them it shares with any partner."""
        missing = size - -(-self.per_cent * size // 100)
        shared = 1 + min(missing // SPARE, size - missing - 1)
        return missing + shared, shared

    @functools.cached_property
    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every rung of sizes, in how many parts its sets are cut, and how many of these are keys.

        No parts where sets of a rung link only if they are equal.
        """
        most = RUNGS[1:] - 1
        only_one = 2 * most * (100 - self.per_cent) // (100 + self.per_cent)
        keys = np.where(only_one > 0, only_one + 1, 0)
        return np.where(only_one > 0, keys + 2 + only_one // SPARE_PARTS, 0), keys

    def sizes_fit(self, small, large):
        """Whether sets of these sizes can link at all."""
        return 100 * small >= self.per_cent * large


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a column, in row order."""
    for start, stop, hashes, first, _ in hashed_words(column):
        joined = hashes.copy()
        for ahead in range(1, words):
            part = mix64(joined[:len(joined) - 1] + np.uint64(ahead)) if len(joined) > 1 else joined[:0]
            joined = mix64(part ^ hashes[ahead:ahead + len(part)])
        for row in range(stop - start):
            low, high = first[row], first[row + 1]
            if high - low >= words:
                yield np.unique(joined[low:high - words + 1])
            elif high > low:
                short = np.uint64(high - low)
                for word in hashes[low:high]:
                    short = mix64(np.array([short ^ word], dtype=np.uint64))[0]
                yield np.array([short], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _set_name(shingles: np.ndarray) -> int:
    """A 64-bit name that equal sets share."""
    with np.errstate(over="ignore"):
        total = mix64(shingles + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
        return int(mix64(np.array([total ^ np.uint64(len(shingles))]))[0].astype(np.int64))


def part_keys(sets: list[np.ndarray], like: Likeness) -> list[np.ndarray]:
    """Keys of every set: hashes of its parts, without those that hold least.

    A set is cut as the sets of its own rung are, and as those of each higher rung in
    which it may have partners.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    own = np.searchsorted(RUNGS, sizes, side="right") - 1
    found: list[list[np.ndarray]] = [[] for _ in sets]
    rows, rungs = np.flatnonzero(sizes), own[sizes > 0]
    while len(rows):
        cut = like.parts[0][rungs] > 0
        for row, keys in zip(rows[cut], _cut([sets[i] for i in rows[cut]], rungs[cut], like), strict=True):
            found[row].append(keys)
        near = like.sizes_fit(sizes[rows], RUNGS[rungs + 1])
        rows, rungs = rows[near], rungs[near] + 1
    return [np.concatenate([np.zeros(0, dtype=np.uint64), *x]) for x in found]


def _cut(sets: list[np.ndarray], rungs: np.ndarray, like: Likeness) -> Iterator[np.ndarray]:
    """The keys of each set, cut as the sets of a rung are."""
    if not sets:
        return
    parts, keys = (x[rungs] for x in like.parts)
    before = np.cumsum(parts) - parts
    sizes = [len(x) for x in sets]
    shingles = np.concatenate(sets)
    high, low = shingles >> np.uint64(32), np.uint64(32)
    part = ((high * np.repeat(parts.astype(np.uint64), sizes)) >> low).astype(np.int64) + np.repeat(before, sizes)
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    total = int(parts.sum())
    held, names = np.bincount(part, minlength=total), np.zeros(total, dtype=np.uint64)
    names[part[heads]] = np.add.reduceat(mix64(shingles + np.uint64(0x2545F491)), heads)
    row, place = np.repeat(np.arange(len(sets)), parts), np.arange(total) - np.repeat(before, parts)
    names = mix64(names ^ mix64((np.repeat(rungs, parts) << 32 | place).astype(np.uint64)))
    order = np.lexsort((names, held, row))
    kept = names[order[place >= np.repeat(parts - keys, parts)]]
    yield from np.split(kept, np.cumsum(keys)[:-1])


def _keyed(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, text_hash, size, set (name), keys and needed (shared ones) of every document."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, len(batch), SET_ROWS):
                piece = batch.slice(at, SET_ROWS)
                sets = list(shingle_sets(piece.column(2), like.words))
                names = [_set_name(x) if len(x) else None for x in sets]
                if like.per_cent >= PARTED:
                    keys, needed = part_keys(sets, like), [1] * len(sets)
                else:
                    prefixes = [like.prefix(len(x)) if len(x) else (0, 0) for x in sets]
                    keys = [x[:length] for x, (length, _) in zip(sets, prefixes, strict=True)]
                    needed = [shared for _, shared in prefixes]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array(names, pa.int64()), pa.array([x.view(np.int64) for x in keys], pa.list_(pa.int64())),
                     pa.array(needed, pa.int32())],
                    names=["doc_id", "text_hash", "size", "set", "keys", "needed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(
        batches, f"doc_id {kind}, text_hash bigint, size bigint, set bigint, "
        "keys array<bigint>, needed int",
    )


def _shared(entries: DataFrame) -> DataFrame:
    """Entries (key, set, needed) whose key another set has too, with ``sharing`` sets.

    A set with fewer such keys than it needs has no links and goes.
    """
    sharing = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = entries.withColumn("sharing", sharing).where(F.col("sharing") > 1)
    enough = Window.partitionBy("set")
    return shared.withColumn("own", F.count(F.lit(1)).over(enough)).where(F.col("own") >= F.col("needed"))


def _chains(keyed: DataFrame, like: Likeness) -> DataFrame:
    """Edges (a, b) between sets that share a key and may link by size.

    The sets of a key, by size, are runs in which each is near enough to the one
    before; every one is joined to the first of its run.
    """
    sets = keyed.where(F.col("size") > 0).groupBy("set").agg(
        F.first("size").alias("size"), F.first("needed").alias("needed"), F.first("keys").alias("keys")
    )
    if like.per_cent >= PARTED:
        kept = sets.select("set", "size", F.explode("keys").alias("key"))
    else:
        entries = sets.select("set", "needed", F.explode("keys").alias("key"))
        for _ in range(PRUNING):
            entries = cut_lineage(_shared(entries.select("key", "set", "needed")))
        # The keys that most sets share are spared, as many as may be.
        common_first = Window.partitionBy("set").orderBy(F.col("sharing").desc(), "key")
        kept = entries.withColumn("place", F.row_number().over(common_first)).where(
            F.col("place") >= F.col("needed")
        ).select("key", "set").join(sets.select("set", "size"), "set")
    by_size = Window.partitionBy("key").orderBy("size", "set")
    so_far = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("size").over(by_size)
    fresh = before.isNull() | (F.col("size") * like.per_cent > before * 100)
    return (
        kept.withColumn("fresh", fresh)
        .withColumn("head", F.last(F.when(F.col("fresh"), F.col("set")), ignorenulls=True).over(so_far))
        .where(~F.col("fresh")).select(F.col("head").alias("a"), F.col("set").alias("b")).distinct()
    )


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmap of each set, a row of 64-bit words: a bit for the hash of each shingle."""
    bits = np.zeros((len(sets), SIGNATURE_BITS), dtype=bool)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bits[rows, (np.concatenate(sets) & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def tile_links(
    one: list[np.ndarray], two: list[np.ndarray] | None, like: Likeness
) -> Iterator[tuple[int, np.ndarray]]:
    """Of two tiles, or within one, each set of the first with those that it links with, by place.

    Sets that have different bits cannot share the shingles behind them: the sizes and
    the number of different bits bound the intersection from above.
    """
    other = one if two is None else two
    marks, other_marks = _signatures(one), _signatures(other)
    sizes = np.array([len(x) for x in other])
    for i, own in enumerate(one):
        low, high = (i + 1, len(other)) if two is None else (0, len(other))
        near = np.arange(low, high)
        near = near[
            like.sizes_fit(np.minimum(sizes[near], len(own)), np.maximum(sizes[near], len(own)))
        ]
        if not len(near):
            continue
        different = np.bitwise_count(other_marks[near] ^ marks[i]).sum(axis=1, dtype=np.int64)
        least = like.least_common(sizes[near], len(own))
        # Every bit that only one side has costs that side a shingle.
        near = near[(sizes[near] + len(own) - different) // 2 >= least]
        if not len(near):
            continue
        lengths = sizes[near]
        joined = np.concatenate([other[j] for j in near])
        at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        common = np.add.reduceat((own[at] == joined).astype(np.int64), np.cumsum(lengths) - lengths)
        linked = near[common >= like.least_common(lengths, len(own))]
        if len(linked):
            yield i, linked


def meeting(
    one: list[np.ndarray], two: list[np.ndarray] | None, copies: np.ndarray, like: Likeness
) -> tuple[np.ndarray, np.ndarray]:
    """For the sets of two tiles, or of one: documents linked with, and place of the class's first.

    ``copies`` counts the documents of each set, those of the second tile after the first's.
    """
    partners = np.zeros(len(copies), dtype=np.int64)
    first = np.arange(len(copies))
    for i, linked in tile_links(one, two, like):
        linked = linked + (0 if two is None else len(one))
        partners[i] += copies[linked].sum()
        partners[linked] += copies[i]
        joined = np.unique(np.append(first[linked], first[i]))
        if len(joined) > 1:
            first[np.isin(first, joined)] = joined[0]
    return partners, first


def _tiles(families: DataFrame) -> DataFrame:
    """``families`` with a tile for each set: a run of sizes of about ``TILE_SHINGLES`` shingles.

    Counted by size, so that no family is sorted as a whole; a size of more shingles than
    that is dealt out by the sets' names. As each set counts for some shingles more, a tile
    is bounded in sets as well.
    """
    sizes = families.groupBy("family", "size").agg((F.count(F.lit(1)) * (F.col("size") + SET_SHINGLES)).alias("n"))
    before = Window.partitionBy("family").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = F.ceil(F.col("n") / TILE_SHINGLES)
    tile = F.floor(F.col("ahead") / TILE_SHINGLES) + F.pmod(F.xxhash64("set"), parts)
    return families.join(runs, ["family", "size"]).withColumn("tile", tile.cast("long")).drop("n", "ahead")


def _verified(docs: DataFrame, families: DataFrame, like: Likeness) -> DataFrame:
    """set, other (the first set of its class there) and partners of the sets that link.

    A set has a row for each meeting in which it links. families: set, size, family,
    copies, doc_id, text_hash.
    """
    tiled = cut_lineage(_tiles(families))
    spans = tiled.groupBy("family", "tile").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    later = spans.select(
        "family", F.col("tile").alias("with"), F.col("least").alias("with_least")
    )
    meetings = spans.join(later, "family").where(
        (F.col("tile") <= F.col("with"))
        & ((F.col("tile") == F.col("with")) | (F.col("with_least") * like.per_cent <= F.col("most") * 100))
    ).select("family", "tile", "with")
    wanted = meetings.select("family", F.explode(F.array_distinct(F.array("tile", "with"))).alias("of"), "tile", "with")

    def sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, len(batch), SET_ROWS):
                piece = batch.slice(at, SET_ROWS)
                found = [x.tobytes() for x in shingle_sets(piece.column(5), like.words)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:5], pa.array(found, pa.binary())],
                    names=["family", "of", "size", "set", "copies", "shingles"],
                )

    # One document of each set in a family gives the set itself.
    givers = tiled.select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "family", F.col("tile").alias("of"),
        "size", "set", "copies",
    )
    if givers.count() <= SHIPPED_GIVERS:
        givers = F.broadcast(givers)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    placed = texts.join(givers, same).select("family", "of", "size", "set", "copies", "text").mapInArrow(
        sets, "family bigint, of bigint, size bigint, set bigint, copies bigint, shingles binary"
    )
    dealt = placed.join(wanted, ["family", "of"]).select(
        "family", "tile", "with", "of", "size", "set", "copies", "shingles"
    )

    def linked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tiles = None, {}

        def finish() -> pa.RecordBatch | None:
            if key is None:
                return None
            none: tuple[list, list, list] = ([], [], [])
            own, other = tiles.get(key[1], none), none if key[1] == key[2] else tiles.get(key[2], none)
            names = np.array(own[0] + other[0], dtype=np.int64)
            copies = np.array(own[1] + other[1], dtype=np.int64)
            if not own[0] or key[1] != key[2] and not other[0]:
                return None
            partners, first = meeting(own[2], None if key[1] == key[2] else other[2], copies, like)
            linked = np.flatnonzero(partners)
            return pa.RecordBatch.from_arrays(
                [pa.array(names[linked]), pa.array(names[first[linked]]), pa.array(partners[linked])],
                names=["set", "other", "partners"],
            )

        for batch in stream:
            rows = zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True)
            for family, tile, partner, of, _, name, n, shingles in rows:
                if (family, tile, partner) != key:
                    if (made := finish()) is not None:
                        yield made
                    key, tiles = (family, tile, partner), {}
                names, copies, content = tiles.setdefault(of, ([], [], []))
                if not names or names[-1] != name:  # equal rows of one id give a set twice
                    names.append(name)
                    copies.append(n)
                    content.append(np.frombuffer(shingles, dtype=np.uint64))
        if (made := finish()) is not None:
            yield made

    return (
        dealt.repartition("family", "tile", "with")
        .sortWithinPartitions("family", "tile", "with", "of", "size", "set")
        .mapInArrow(linked, "set bigint, other bigint, partners bigint")
    )


@dataclass(frozen=True)
class Joined:
    """Documents with their sets, each set's documents, linked documents and class.

    sets: set, copies, lowest (id), partners, class.
    """

    documents: DataFrame
    sets: DataFrame


def join_sets(docs: DataFrame, like: Likeness) -> Joined:
    """Run the join over ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    keyed = cut_lineage(_keyed(docs, like))
    edges = cut_lineage(_chains(keyed, like))
    family = connected(edges)
    givers = keyed.where(F.col("size") > 0).groupBy("set").agg(
        F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("lowest"),
        F.min(F.struct("doc_id", "text_hash")).alias("giver"),
    )
    members = family.join(givers, family["node"] == givers["set"]).select(
        "set", "size", F.col("component").alias("family"), "copies", "giver.doc_id", "giver.text_hash"
    )
    links = cut_lineage(_verified(docs, members, like))
    classes = connected(links.select(F.col("set").alias("a"), F.col("other").alias("b")))
    partners = links.groupBy("set").agg(F.sum("partners").alias("partners"))
    sets = givers.join(classes, givers["set"] == classes["node"], "left").join(partners, "set", "left").select(
        "set", "copies", "lowest", F.coalesce("partners", F.lit(0)).alias("partners"),
        F.coalesce("component", "set").alias("class"),
    )
    return Joined(keyed.drop("keys", "needed"), cut_lineage(sets))


def linked_documents(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document."""
    joined = join_sets(docs, like)
    rows, sets = joined.documents, joined.sets
    ids = sets.groupBy("class").agg(F.min("lowest").alias("component_id"))
    named = sets.join(ids, "class").select(
        F.col("set").alias("of"), "component_id", (F.col("copies") - 1 + F.col("partners")).alias("n_links")
    )
    return rows.join(named, rows["set"] == named["of"], "left").select(
        rows["doc_id"], rows["size"].alias("n_shingles"),
        F.coalesce("component_id", rows["doc_id"]).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, like: Likeness) -> DataFrame:
    """``docs`` with one row of each class: the lowest id, of its rows the lowest text hash.

    Documents without words have no links and all stay. What goes is named by id and
    text hash and is taken out where the documents are read, unless there is too much of
    it to ship.
    """
    joined = join_sets(docs, like)
    rows = joined.documents.where(F.col("size") > 0)
    members = rows.join(joined.sets.select("set", "class"), "set").select(
        "class", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("row"),
    ).groupBy("class", "row").agg(F.count(F.lit(1)).alias("copies"))
    first = members.groupBy("class").agg(F.min("row").alias("first"))
    judged = cut_lineage(
        members.join(first, "class").where((F.col("row") != F.col("first")) | (F.col("copies") > 1)).select(
            F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash"),
            (F.col("row") == F.col("first")).alias("stays"),
        )
    )
    counts = {r[0]: r[1] for r in judged.groupBy("stays").count().collect()}

    def named(stays: bool | None) -> DataFrame:
        found = judged if stays is None else judged.where(F.col("stays") == stays)
        return F.broadcast(found) if sum(counts.values()) <= SHIPPED_GIVERS else found

    # A row is one column here, so that its own names cannot clash with working ones.
    packed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    out = packed.join(named(None), same, "left_anti")
    if counts.get(True):  # equal rows of one id, of which one stays
        out = out.unionByName(packed.join(named(True), same, "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return out.select("row.*")
