"""Exact cosine top-k without emitting a query x index pair table.

Each task multiplies a block of queries by blocks of index vectors and keeps the
best k per query, so what leaves a task is k rows per query, not one row per
pair. Ties go to the earlier index position. Work is done in slices, so what a
task holds beside its two blocks does not grow with them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orbitrank.session import cut_lineage

# Queries are shipped whole only below this many bytes; above it both sides are
# packed into blocks of about CHUNK_BYTES, which meet in a cross join. A task meets
# about PART_BYTES of the index.
SHIPPED_QUERY_BYTES = 64 * 1024 * 1024
CHUNK_BYTES = 4 * 1024 * 1024
PART_BYTES = 64 * 1024 * 1024
# What a task keeps of one hit: score, position, and two references.
HIT_BYTES = 64
CHUNK_ROWS = 16_384
_QUERY_SLICE = 512
_INDEX_SLICE = 8_192
_PAIR_SLICE = 16_384
# Vectors of a block that are at most so far from its first make a group, which a query
# meets as one. A block of more groups than one in so many rows is met row by row, and so
# is a slice of which more than that share of pairs is left.
GROUP_RADIUS = 0.3
GROUP_ROWS, LEFT_ONE_IN = 3, 16
_GROUP_SLICE = 1_024
# At most so many cells deal out the rows; so many blocks of a cell's index give its queries a bound.
MOST_CELLS, _NEAR_BLOCKS = 1_024, 2

# Scores are compared after rounding, so copies of a vector tie whatever order
# a processor sums their products in.
SCORE_DIGITS = 9

PARTIAL_SCHEMA = (
    "query_id string, item_id string, position bigint, item_label string, score double"
)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit-length float64 rows of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    for start in range(0, len(rows), _INDEX_SLICE):
        part = rows[start:start + _INDEX_SLICE]
        norms = np.sqrt((part * part).sum(axis=1, keepdims=True))
        if not (np.isfinite(norms).all() and (norms > 0).all()):
            raise ValueError("vectors must be finite and non-zero; see vector_violations")
        part /= norms
    return rows


def _pair_scores(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Double-precision cosines of chosen pairs, a bounded slice at a time."""
    out = np.empty(len(row))
    for start in range(0, len(row), _PAIR_SLICE):
        part = slice(start, start + _PAIR_SLICE)
        out[part] = np.einsum("ij,ij->i", queries[row[part]], vectors[col[part]])
    return np.round(out, SCORE_DIGITS)


@dataclass(frozen=True)
class Groups:
    """Runs of a block's rows: where each begins, its rows, and how far they are from its first."""

    heads: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    @staticmethod
    def of(heads: np.ndarray, radii: np.ndarray, n: int) -> Groups | None:
        return Groups(heads, np.diff(heads, append=n), radii) if len(heads) else None


def grouped(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of unit vectors by groups, where each group begins, and its radius.

    A vector joins the nearest group whose first one is near enough, or begins one. No
    groups where there would be too many.
    """
    n, near = len(vectors), np.float32(1 - GROUP_RADIUS**2 / 2)
    rough = vectors.astype(np.float32)
    owner, leaders, found = np.full(n, -1), np.empty((n // GROUP_ROWS, vectors.shape[1]), dtype=np.float32), 0
    none = np.arange(n), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    for start in range(0, n, _GROUP_SLICE):
        rows = np.arange(start, min(start + _GROUP_SLICE, n))
        if found:
            scores = rough[rows] @ leaders[:found].T
            best = scores.argmax(axis=1)
            joins = scores[np.arange(len(rows)), best] >= near
            owner[rows[joins]] = best[joins]
            rows = rows[~joins]
        alike = rough[rows] @ rough[rows].T >= near
        free = np.ones(len(rows), dtype=bool)
        for at in range(len(rows)):
            if free[at]:
                if found == len(leaders):
                    return none
                leaders[found] = rough[rows[at]]
                joins = alike[at] & free
                joins[at] = True
                owner[rows[joins]] = found
                free &= ~joins
                found += 1
    order = np.argsort(owner, kind="stable")
    heads = np.searchsorted(owner[order], np.arange(found))
    away = vectors[order] - np.repeat(vectors[order[heads]], np.diff(heads, append=n), axis=0)
    radii = np.maximum.reduceat(np.sqrt((away * away).sum(axis=1)), heads) if found else np.zeros(0)
    return order, heads, (radii * (1 + 1e-6) + 1e-6).astype(np.float32)


def _reached(scores: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores that reach their row's cut; few, so a flat search is faster."""
    return np.divmod(np.flatnonzero(scores >= cut), scores.shape[1])


class _Running:
    """The best k seen so far for each query of one task."""

    def __init__(self, query_ids: list[str], queries: np.ndarray, k: int) -> None:
        n = len(query_ids)
        self.k = k
        self.query_ids = np.asarray(query_ids, dtype=object)
        self.row_of = {query_id: row for row, query_id in enumerate(query_ids)}
        self.queries = queries
        self.rough = queries.astype(np.float32)
        self.scores = np.full((n, k), -np.inf)
        # Scores that k hits of a query have, here or elsewhere.
        self.floors = np.full(n, -np.inf)
        self.positions = np.full((n, k), np.iinfo(np.int64).max)
        self.items = np.full((n, k), None, dtype=object)
        self.labels = np.full((n, k), None, dtype=object)

    def offer(self, vectors, positions, items, labels, exclude_self: bool, groups: Groups | None = None) -> None:
        """Compare every query with a batch of index rows.

        A single-precision product rules out almost every pair: its error is below
        ``margin``, so only pairs within it of the current k-th best are scored in
        double precision. Where the rows lie in groups, it is made with the first of each
        group, and the group's radius bounds the others.
        """
        margin = (vectors.shape[1] + 4) * 1.2e-7
        own = np.full(len(items), -1)
        if exclude_self:
            own = np.fromiter((self.row_of.get(item, -1) for item in items), np.int64, len(items))
        step = _INDEX_SLICE if groups is None else max(1, len(vectors))
        for start in range(0, len(vectors), step):
            part = slice(start, start + step)
            rough = None
            if groups is not None:
                near, met = vectors.astype(np.float32), own[groups.heads]
                first = near[groups.heads].T
            for top in range(0, len(self.queries), _QUERY_SLICE):
                rows = slice(top, top + _QUERY_SLICE)
                if groups is not None:
                    scores = self.rough[rows] @ first
                    hopes = scores + groups.radii
                    cut = self._cut(rows, scores, met, margin)
                    row, group = _reached(hopes, cut)
                    many = groups.sizes[group]
                    if many.sum() * LEFT_ONE_IN <= len(scores) * len(vectors):
                        col = np.repeat(groups.heads[group] - np.cumsum(many) + many, many) + np.arange(many.sum())
                        row = np.repeat(row, many)
                        left = self._rough_pairs(rows, near, row, col) >= cut[row, 0]
                        left &= own[col] != row + top
                        self._take(rows, row[left], col[left], vectors, positions, items, labels)
                        continue
                if rough is None:
                    rough = vectors[part].astype(np.float32).T
                scores = self.rough[rows] @ rough
                cut = self._cut(rows, scores, own[part], margin)
                row, col = _reached(scores, cut)
                self._take(rows, row, col + start, vectors, positions, items, labels)

    def _cut(self, rows: slice, scores, own, margin: float) -> np.ndarray:
        """What a rough score must reach, a column of queries; pairs of a query with itself are ruled out."""
        top = rows.start
        itself = np.flatnonzero((own >= top) & (own < top + len(scores)))
        scores[own[itself] - top, itself] = -np.inf
        worst = np.maximum(self.scores[rows, -1], self.floors[rows])
        cut = worst - margin - 10.0**-SCORE_DIGITS
        unfilled = np.flatnonzero(np.isneginf(worst))
        if len(unfilled) and scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            cut[unfilled] = np.partition(scores[unfilled], at, axis=1)[:, at] - 2 * margin
        return np.maximum(cut, -2.0)[:, None].astype(np.float32)

    def _rough_pairs(self, rows: slice, vectors, row, col) -> np.ndarray:
        """Single-precision cosines of chosen pairs."""
        out, queries = np.empty(len(row), dtype=np.float32), self.rough[rows]
        for start in range(0, len(row), _PAIR_SLICE):
            part = slice(start, start + _PAIR_SLICE)
            out[part] = np.einsum("ij,ij->i", queries[row[part]], vectors[col[part]])
        return out

    def _take(self, rows: slice, row, col, vectors, positions, items, labels) -> None:
        """Score chosen pairs exactly and keep the best."""
        if len(row):
            exact = _pair_scores(self.queries[rows], vectors, row, col)
            self._merge(rows, row, exact, positions[col], items[col], labels[col])

    def _merge(self, rows: slice, row, scores, positions, items, labels) -> None:
        """Fold candidate pairs into the kept ones, by score then position."""
        n, k = self.scores[rows].shape
        owner = np.concatenate([np.repeat(np.arange(n), k), row])
        scores = np.concatenate([self.scores[rows].ravel(), scores])
        positions = np.concatenate([self.positions[rows].ravel(), positions])
        order = np.lexsort((positions, -scores, owner))
        owner = owner[order]
        first = np.searchsorted(owner, np.arange(n))
        keep = order[(first[:, None] + np.arange(k)).ravel()]
        self.scores[rows] = scores[keep].reshape(n, k)
        self.positions[rows] = positions[keep].reshape(n, k)
        self.items[rows] = np.concatenate([self.items[rows].ravel(), items])[keep].reshape(n, k)
        self.labels[rows] = np.concatenate([self.labels[rows].ravel(), labels])[keep].reshape(n, k)

    def table(self) -> pa.Table:
        kept = np.isfinite(self.scores)
        rows = np.nonzero(kept)[0]
        return pa.table(
            {
                "query_id": pa.array(self.query_ids[rows], pa.string()),
                "item_id": pa.array(self.items[kept], pa.string()),
                "position": pa.array(self.positions[kept], pa.int64()),
                "item_label": pa.array(self.labels[kept], pa.string()),
                "score": pa.array(self.scores[kept], pa.float64()),
            }
        )


def _offer_batch(running: _Running, batch, exclude_self: bool) -> None:
    if batch.num_rows == 0:
        return
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    running.offer(
        _matrix(column["vector"]),
        column["position"].to_numpy(zero_copy_only=False)
        if isinstance(column["position"], pa.Array) else column["position"].to_numpy(),
        np.asarray(column["item_id"].to_pylist(), dtype=object),
        np.asarray(column["item_label"].to_pylist(), dtype=object),
        exclude_self,
    )


def merge_best(partial: DataFrame, k: int) -> DataFrame:
    """Reduce per-task bests to the ranked best k of every query.

    The planner limits every map-side partition to k rows per query before the
    shuffle (``WindowGroupLimit``).
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _sides(queries: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = queries.select("query_id", "vector")
    right = index.select("item_id", "position", "item_label", "vector")
    return left, right


def keyed_topk(
    queries: DataFrame, index: DataFrame, keys: list[str], k: int, exclude_self: bool = True
) -> DataFrame:
    """Partial top-k between the queries and index rows that share ``keys``.

    The caller guarantees that no key holds more than a chunk of either side.
    """
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        running = _Running(left.column("query_id").to_pylist(), _matrix(left.column("vector")), k)
        if left.num_rows:
            _offer_batch(running, right, exclude_self)
        return running.table()

    return (
        queries.select(*keys, "query_id", "vector")
        .groupBy(*keys)
        .cogroup(
            index.select(*keys, "item_id", "position", "item_label", "vector").groupBy(*keys)
        )
        .applyInArrow(score, PARTIAL_SCHEMA)
    )


def _in_cells(side: DataFrame, centres: np.ndarray) -> DataFrame:
    """``side`` with the cell of each row: the nearest centre, of equal ones any."""
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(0)
        for batch in batches:
            cells = np.zeros(len(batch), dtype=np.int32)
            unit = _matrix(batch.column("vector")).astype(np.float32)
            for start in range(0, len(unit), _QUERY_SLICE):
                scores = unit[start:start + _QUERY_SLICE] @ centres.T
                best = scores >= scores.max(axis=1, keepdims=True) - np.float32(1e-6)
                cells[start:start + _QUERY_SLICE] = (best * (1 + draw.random(scores.shape, dtype=np.float32))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return side.mapInArrow(nearest, T.StructType([*side.schema.fields, T.StructField("cell", T.IntegerType())]))


def _blocks(both: DataFrame, parts: int, rows: int, k: int, exclude_self: bool) -> DataFrame:
    """``both`` sides in ``parts`` partitions of rows that hold a block of vectors each.

    A block has the unit vectors of at most ``rows`` rows of one cell and side as bytes, and
    their other columns as lists; those of the index lie by groups. A block of queries has, as
    ``floors``, the k-th best score of each among the last blocks of the index in its cell.
    Blocks are written, so each can be read by many tasks.
    """
    names = ["query_id", "item_id", "position", "item_label"]

    def block(held: list[pa.RecordBatch], near: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        vectors, asks = _matrix(table.column("vector")), table.column("asks")[0].as_py()
        heads, radii, floors = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), np.zeros(0)
        if asks:
            running = _Running(table.column("query_id").to_pylist(), vectors, k)
            for of in near:
                running.offer(*of[:-1], exclude_self, of[-1])
            floors = running.scores[:, -1]
        else:
            order, heads, radii = grouped(vectors)
            table, vectors = table.take(pa.array(order)), vectors[order]
            items = np.asarray(table.column("item_id").to_pylist(), dtype=object)
            near.append((vectors, table.column("position").to_numpy(), items, items, Groups.of(heads, radii, len(vectors))))
            del near[:-_NEAR_BLOCKS]
        ends = pa.array([0, len(table)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([asks]), *[pa.ListArray.from_arrays(ends, table.column(name).combine_chunks()) for name in names],
             *[pa.array([x.tobytes()], pa.binary()) for x in (vectors, heads.astype(np.int64), radii, floors)]],
            names=["asks", *names, "vectors", "heads", "radii", "floors"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, key, near = [], 0, None, []
        for batch in batches:
            kinds = batch.column("cell").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            borders = np.flatnonzero(np.diff(kinds)) + 1
            for start, stop in zip([0, *borders], [*borders, len(kinds)], strict=True):
                while start < stop:
                    if n and (kinds[start] != key or n == rows):
                        yield block(held, near)
                        held, n = [], 0
                    if key is not None and kinds[start] // 2 != key // 2:
                        near = []
                    key = kinds[start]
                    held.append(batch.slice(start, min(stop - start, rows - n)))
                    start += len(held[-1])
                    n += len(held[-1])
        if n:
            yield block(held, near)

    kinds = ", ".join(f"{name} array<{both.schema[name].dataType.simpleString()}>" for name in names)
    return cut_lineage(both.repartition(parts, "cell").sortWithinPartitions("cell", "asks").mapInArrow(
        pack, f"asks boolean, {kinds}, vectors binary, heads binary, radii binary, floors binary"
    ))


def grid_topk(
    queries: DataFrame, index: DataFrame, n_queries: int, n_index: int, k: int,
    exclude_self: bool = True, chunk_rows: int = CHUNK_ROWS, part_rows: int = 16 * CHUNK_ROWS,
) -> DataFrame:
    """Top-k when neither side may be shipped whole: blocks of both meet in a cross join.

    Each vector crosses one shuffle and is written once. A task reads a part of the
    queries and a part of the index where they were written, so no copies of vectors
    are dealt out, and k rows for each query and part of the index leave the tasks.

    Both sides are dealt by cells around some index vectors. So near ones come to lie in
    one block, whose groups are met as one (``Groups``), and the scores in its own cell
    give each query a bound for all other blocks.
    """
    across = max(1, math.ceil(n_queries / chunk_rows))
    spread = math.ceil(2 * queries.sparkSession.sparkContext.defaultParallelism / across)
    down = max(1, math.ceil(n_index / part_rows), min(spread, math.ceil(n_index / chunk_rows)))
    left, right = _sides(queries, index)
    both = right.select(F.lit(False).alias("asks"), F.lit(None).cast("string").alias("query_id"), *right.columns).unionByName(
        left.select(
            F.lit(True).alias("asks"), "query_id", "vector", F.lit(None).cast("string").alias("item_id"),
            F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("item_label"),
        )
    )
    cells = min(MOST_CELLS, max(n_queries, n_index) // chunk_rows)
    parts = max(across, down, cells)
    if cells > 1:
        some = right.select("vector", F.xxhash64("item_id").alias("at")).orderBy("at").limit(cells).select("vector").toArrow()
        both = _in_cells(both, _matrix(some.column("vector")).astype(np.float32))
    else:
        both = both.withColumn("cell", F.pmod(F.xxhash64("query_id", "item_id"), F.lit(parts)).cast("int"))
    blocks = _blocks(both, parts, chunk_rows, k, exclude_self)
    left = blocks.where("asks").select(
        F.col("query_id").alias("queries"), F.col("vectors").alias("matrix"), "floors", F.monotonically_increasing_id().alias("block"),
    )
    right = blocks.where("not asks").drop("asks", "query_id", "floors").coalesce(down)

    def matrix(blob, n: int) -> np.ndarray:
        return np.frombuffer(blob.as_buffer(), np.float64).reshape(n, -1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs of blocks come by block of queries; any other order only gives more rows to merge.
        running, current = None, None
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}
                if row["block"].as_py() != current:
                    if running is not None:
                        yield from running.table().to_batches()
                    current = row["block"].as_py()
                    ids = row["queries"].as_py()
                    # Copies: the batch that holds the bytes is let go.
                    running = _Running(ids, matrix(row["matrix"], len(ids)).copy(), k)
                    running.floors = np.frombuffer(row["floors"].as_buffer(), np.float64).copy()
                items = row["item_id"].values
                running.offer(
                    matrix(row["vectors"], len(items)), row["position"].values.to_numpy(zero_copy_only=False),
                    np.asarray(items.to_pylist(), dtype=object),
                    np.asarray(row["item_label"].values.to_pylist(), dtype=object), exclude_self,
                    Groups.of(
                        np.frombuffer(row["heads"].as_buffer(), np.int64),
                        np.frombuffer(row["radii"].as_buffer(), np.float32), len(items),
                    ),
                )
        if running is not None:
            yield from running.table().to_batches()

    return merge_best(left.crossJoin(right).mapInArrow(score, PARTIAL_SCHEMA), k)


def shipped_topk(
    queries: DataFrame, index: DataFrame, k: int, exclude_self: bool = True
) -> DataFrame:
    """Top-k with a small query side shipped to every task; the index never shuffles."""
    left, right = _sides(queries, index)
    table = left.toArrow()
    ids = table.column("query_id").to_pylist()
    shipped = queries.sparkSession.sparkContext.broadcast((ids, _matrix(table.column("vector"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shipped.value
        running = _Running(query_ids, matrix, k)
        for batch in batches:
            if query_ids:
                _offer_batch(running, batch, exclude_self)
        yield from running.table().to_batches()

    return merge_best(right.mapInArrow(score, PARTIAL_SCHEMA), k)


def exact_topk(
    queries: DataFrame, index: DataFrame, k: int, exclude_self: bool = True,
    shipped_bytes: int = SHIPPED_QUERY_BYTES,
) -> DataFrame:
    """The k most similar index rows of every query, ranked from 1.

    ``queries`` has (query_id, vector); ``index`` has (item_id, position, item_label,
    vector). The query side is measured, vectors and k hits of each query together:
    below ``shipped_bytes`` it is shipped to the tasks that scan the index where it
    lies, otherwise both sides meet chunk by chunk. A repeated query id is refused, as
    the hits of its vectors could not be told apart.
    """
    if k < 1:
        raise ValueError("k must be positive")
    measured = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d"),
        F.count_distinct("query_id").alias("ids"),
    ).first()
    if measured["ids"] != measured["n"]:
        raise ValueError("query ids must be present and distinct")
    if measured["n"] * (8 * max(measured["d"], 1) + HIT_BYTES * k) <= shipped_bytes:
        return shipped_topk(queries, index, k, exclude_self)
    rows = max(k, min(_INDEX_SLICE, CHUNK_BYTES // (8 * measured["d"])))
    part = max(rows, PART_BYTES // (8 * measured["d"]))
    return grid_topk(queries, index, measured["n"], index.count(), k, exclude_self, rows, part)
