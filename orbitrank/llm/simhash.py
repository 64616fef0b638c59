"""Near copies by SimHash: fingerprints, BK-trees over shards of them, classes of linked ones.

1. A document's fingerprint has the bits that over half of its shingles' hashes have.
   Equal fingerprints are one from here on, whatever the number of copies.
2. Two fingerprints of at most ``RADIUS`` different bits agree in one of ``RADIUS`` + 1
   bands of bits. Fingerprints that agree in a band are a group. A crowded group is
   divided by the bands of its other bits, and these once more, which loses no link.
3. A group is one shard; what is still crowded then is dealt out over several. A shard's
   fingerprints make a BK-tree, whose children are keyed by their distance to the parent.
   A search follows only the edges from distance - radius to distance + radius.
4. Every fingerprint searches its own shard's tree. If its group has more shards, each
   tree is shipped to all of the group's shards, two shards at a time.
5. A search gives a chain through each class that it sees, never the pairs. Connected
   components of the chains are the classes.

Trees of many small shards are built and searched together, level by level in arrays; a
step holds at most ``PAIRS`` comparisons. Trees reach the shards that need them by a
shuffle: they grow with the corpus, so they are not sent through the driver.

Defined results: null and empty texts and texts without words have fingerprint zero and
link like any other; fewer words than a shingle has are one shingle; shingles count as
often as they occur; repeated rows and rows of one id are rows of their own; a null id
names no class unless the class has no other. Columns other than doc_id and text are
left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitrank.llm.components import connected
from orbitrank.session import cut_lineage

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Widths of the bands on each level; four of a level are the bits that are left there.
BANDS = (16, 12, 9)
#: Fingerprints of a group, beyond which it is divided, and aimed at in a shard.
CROWD = 4_096
#: Shards of this many fingerprints are worked on together.
TOGETHER = 1 << 15
#: Comparisons held at once.
PAIRS = 1 << 20
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 15
#: Copies of a row that spread the rows of one crowded key over tasks.
SALTS = 32
#: A fingerprint that one of so many rows has is shipped with its class.
HOT_SHARE = 1_000


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of every shingle of a text, repeats included."""
    hashed = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "replace").lower().split()  # A-Z and the bytes of white space alone
    if len(words) < WORDS:
        return [hashed(b" ".join(words), SEED)] if words else []
    return [hashed(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(WORDS)), strict=False)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str) -> int:
    """The fingerprint of a text as an unsigned number."""
    hashes = np.array(shingle_hashes(text), dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES):
        counts += _bit_counts(hashes[at:at + SHINGLES])
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (the fingerprint's bits as a signed number) of every row of ``docs``."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = [fingerprint(text.as_py() or "") for text in batch.column(1)]
            prints = np.array(made, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(batches, f"doc_id {kind}, print bigint")


def _divided(groups: DataFrame, width: int, left: int) -> DataFrame:
    """Groups (key, rest, print) by each band of ``width`` of the ``left`` bits in ``rest``."""
    bands = []
    for number in range(RADIUS + 1):
        low = number * width
        band = F.shiftrightunsigned("rest", low).bitwiseAND((1 << width) - 1)
        above = F.shiftleft(F.shiftrightunsigned("rest", low + width), low) if low + width < left else F.lit(0)
        below = F.col("rest").bitwiseAND((1 << low) - 1)
        key = F.shiftleft("key", width + 2).bitwiseOR(F.shiftleft(F.lit(number).cast("bigint"), width)).bitwiseOR(band)
        bands.append(F.struct(key.alias("key"), above.bitwiseOR(below).cast("bigint").alias("rest")))
    return groups.select(F.explode(F.array(*bands)).alias("group"), "print").select("group.*", "print")


def _salt() -> Column:
    return F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int")


def shards(prints: DataFrame) -> DataFrame:
    """group, n_shards, shard and print: each print of ``prints`` once for each of its groups.

    A group's name is its level and the bits that its members agree in.
    """
    found = None
    groups = prints.select(F.lit(0).cast("bigint").alias("key"), F.col("print").alias("rest"), "print")
    left = BITS
    for level, width in enumerate(BANDS):
        groups = cut_lineage(_divided(groups, width, left))
        left -= width
        sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
        crowded = cut_lineage(sizes)
        last = level + 1 == len(BANDS)
        # Rows of one key are spread over tasks before they meet its size.
        spread = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = groups.withColumn("salt", _salt()).join(spread, ["key", "salt"], "left")
        done = sized if last else sized.where(F.col("n").isNull())
        named = done.select(
            F.concat_ws(":", F.lit(level), "key").alias("group"),
            F.coalesce(F.ceil(F.col("n") / CROWD), F.lit(1)).cast("int").alias("n_shards"), "print",
        )
        found = named if found is None else found.unionByName(named)
        if last or crowded.isEmpty():
            break
        groups = sized.where(F.col("n").isNotNull()).select("key", "rest", "print")
    return found.withColumn("shard", F.pmod(F.xxhash64("print", F.lit(1)), F.col("n_shards")).cast("int"))


def build_trees(prints: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees over runs of different prints; ``first`` has the place of each print's run.

    A run's first print is its tree's root. Returns edges, sorted, each as its parent's
    place * 65 + distance, and the child that each leads to.
    """
    pending = np.flatnonzero(first != np.arange(len(prints)))
    parent = first[pending]
    edges, children = [], []
    while len(pending):
        edge = parent * (BITS + 1) + np.bitwise_count(prints[pending] ^ prints[parent])
        order = np.argsort(edge, kind="stable")
        edge, pending = edge[order], pending[order]
        fresh = np.ones(len(edge), dtype=bool)
        fresh[1:] = edge[1:] != edge[:-1]
        edges.append(edge[fresh])
        children.append(pending[fresh])
        # What has the distance of a new child hangs below that child.
        parent = pending[fresh][np.cumsum(fresh) - 1][~fresh]
        pending = pending[~fresh]
    if not edges:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge, child = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edge)
    return edge[order], child[order]


def search(
    prints: np.ndarray, edges: np.ndarray, children: np.ndarray, queries: np.ndarray, roots: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and of the prints within the radius of them, from each query's root down."""
    hits, query, node = [], np.arange(len(queries)), roots
    while len(query):
        apart = np.bitwise_count(queries[query] ^ prints[node]).astype(np.int64)
        near = apart <= RADIUS
        hits.append((query[near], node[near]))
        low = np.searchsorted(edges, node * (BITS + 1) + np.maximum(apart - RADIUS, 0))
        high = np.searchsorted(edges, node * (BITS + 1) + np.minimum(apart + RADIUS, BITS), side="right")
        many = high - low
        begin = np.repeat(low - (np.cumsum(many) - many), many)
        query = np.repeat(query, many)
        node = children[begin + np.arange(len(begin))]
    return np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])


def _joined(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Give the places that links connect the least label among them, in place."""
    while True:
        a, b = label[one], label[two]
        apart = a != b
        if not apart.any():
            return
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            onward = label[label]
            if np.array_equal(onward, label):
                break
            label[:] = onward


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of queries whose trees have at most ``PAIRS`` prints together, or one query."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        yield slice(at, stop)
        at = stop


def _links(
    prints: np.ndarray, edges: np.ndarray, children: np.ndarray, queries: np.ndarray, roots: np.ndarray,
    sizes: np.ndarray, label: np.ndarray, own: int,
) -> None:
    """Join labels of queries, which begin at place ``own``, and of the prints that they find."""
    for part in _chunks(sizes):
        query, node = search(prints, edges, children, queries[part], roots[part])
        _joined(label, query + part.start + own, node)


def _chain(label: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    """Edges (a, b) that lead once through the prints of each label."""
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    values = prints[order].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(values[:-1][same]), pa.array(values[1:][same])], names=["a", "b"])


def shard_chains(prints: np.ndarray, first: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Chains of the classes within runs of prints, and the runs' trees."""
    edges, children = build_trees(prints, first)
    sizes = np.bincount(first, minlength=len(prints))[first]
    label = np.arange(len(prints))
    _links(prints, edges, children, prints, first, sizes, label, 0)
    return _chain(label, prints), edges, children


def meeting_chains(
    prints: np.ndarray, edges: np.ndarray, children: np.ndarray, queries: np.ndarray
) -> pa.RecordBatch:
    """Chains of the classes that another shard's prints make with a tree's."""
    label = np.arange(len(prints) + len(queries))
    roots, sizes = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(prints))
    _links(prints, edges, children, queries, roots, sizes, label, len(prints))
    return _chain(label, np.concatenate([prints, queries]))


_TREE = "group string, n_shards int, shard int, a bigint, b bigint, prints binary, edges binary, children binary"


def _planted(dealt: DataFrame) -> DataFrame:
    """Rows of two kinds: a chain's edge (a, b), or the tree of a shard that has to meet others."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of whole shards: group, number of shards, shard, prints

        def edges_of(made: pa.RecordBatch) -> pa.RecordBatch:
            n = len(made)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), made.column(0),
                 made.column(1), *[pa.nulls(n, pa.binary())] * 3], names=names,
            )

        def finish() -> Iterator[pa.RecordBatch]:
            small = [x[3] for x in held if x[1] == 1 and len(x[3]) > 1]
            if small:
                lengths = np.array([len(x) for x in small])
                first = np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield edges_of(shard_chains(np.concatenate(small), first)[0])
            for group, shard_count, shard, prints in held:
                if shard_count > 1:
                    made, edges, children = shard_chains(prints, np.zeros(len(prints), dtype=np.int64))
                    yield edges_of(made)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group]), pa.array([shard_count], pa.int32()), pa.array([shard], pa.int32()),
                         pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([prints.tobytes()], pa.binary()),
                         pa.array([edges.tobytes()], pa.binary()), pa.array([children.tobytes()], pa.binary())],
                        names=names,
                    )
            held.clear()

        names = [x.split()[0] for x in _TREE.split(", ")]
        key, count, many, parts = None, 0, 0, []
        for batch in stream:
            frame = [batch.column(i) for i in range(3)]
            prints = batch.column(3).to_numpy().view(np.uint64)
            keys = list(zip(*(x.to_pylist() for x in frame), strict=True))
            begins = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for low, high in zip(begins, [*begins[1:], len(keys)], strict=True):
                if keys[low] != key:
                    if key is not None:
                        held.append((*key, np.concatenate(parts)))
                        many += count
                    if many >= TOGETHER:
                        yield from finish()
                        many = 0
                    key, count, parts = keys[low], 0, []
                parts.append(prints[low:high])
                count += high - low
        if key is not None:
            held.append((*key, np.concatenate(parts)))
            yield from finish()

    return (
        dealt.select("group", "n_shards", "shard", "print").repartition("group", "shard")
        .sortWithinPartitions("group", "shard", "print").mapInArrow(batches, _TREE)
    )


def _met(trees: DataFrame) -> DataFrame:
    """Chains (a, b) across the shards of a group: each tree against the prints of the shards before it."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries = None, None
        for batch in stream:
            for at in range(len(batch)):
                group, later, earlier, is_tree = (batch.column(i)[at].as_py() for i in range(4))
                prints, edges, children = (
                    np.frombuffer(batch.column(i)[at].as_py(), dtype=x)
                    for i, x in ((4, np.uint64), (5, np.int64), (6, np.int64))
                )
                if not is_tree:
                    key, queries = (group, later, earlier), prints
                elif (group, later, earlier) == key:
                    yield meeting_chains(prints, edges, children, queries)

    to_all = trees.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)))
    return (
        to_all.where(F.col("other") != F.col("shard"))
        .select(
            "group", F.greatest("shard", "other").alias("later"), F.least("shard", "other").alias("earlier"),
            (F.col("shard") > F.col("other")).alias("is_tree"), "prints",
            *(F.when(F.col("shard") > F.col("other"), F.col(x)).otherwise(F.lit(b"")).alias(x) for x in ("edges", "children")),
        )
        .repartition("group", "later", "earlier").sortWithinPartitions("group", "later", "earlier", "is_tree")
        .mapInArrow(batches, "a bigint, b bigint")
    )


def linked_prints(prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose connected components are the classes of different ``prints`` (print)."""
    planted = cut_lineage(_planted(shards(prints)))
    within = planted.where(F.col("a").isNotNull()).select("a", "b")
    return within.unionByName(_met(planted.where(F.col("shard").isNotNull())))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``."""
    rows = cut_lineage(fingerprints(docs))
    prints = cut_lineage(
        rows.groupBy("print").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("copies"))
    )
    classes = connected(linked_prints(prints.select("print")))
    placed = prints.join(classes, prints["print"] == classes["node"], "left").select(
        "print", "lowest", "copies", F.coalesce("component", "print").alias("class")
    )
    ids = placed.groupBy("class").agg(F.min("lowest").alias("component_id"))
    named = cut_lineage(placed.join(ids, "class").select("print", "copies", "component_id"))
    # At most HOT_SHARE fingerprints have that share of the rows: they are shipped, the
    # others joined by key, so no task gets all rows of a common fingerprint.
    total = named.agg(F.sum("copies")).first()[0] or 0
    common = F.col("copies") * HOT_SHARE >= total
    hot = F.broadcast(named.where(common).drop("copies"))
    joined = rows.join(hot, "print").unionByName(
        rows.join(F.broadcast(hot.select("print")), "print", "left_anti").join(named.where(~common).drop("copies"), "print")
    )
    return joined.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
