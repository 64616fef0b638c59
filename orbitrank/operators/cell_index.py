"""A saved approximate index: vectors in cells of two-level centres, read cell by cell.

Centres are rows of the index itself, the first ones in hashed order: ``coarse`` of all
rows, and ``fine`` of the rows of each coarse cell. Nothing is fitted, any engine can
repeat the choice, and growing data only means larger cells until the index is saved
anew with more of them. A vector belongs to the fine centre nearest to it among those of
its nearest coarse centre, so it is compared with coarse + fine centres, not with their
product. Products are compared after rounding to nine digits, the lower centre first.

The table is partitioned by cell. A search reads the cells that its queries probe and no
others. What is shipped to the tasks are the centres, which the two numbers bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitrank.functions.hashing import hashed_order
from orbitrank.functions.vectors import l2_normalize
from orbitrank.operators.ann import cell_topk
from orbitrank.session import cut_lineage

#: Bytes that all centres may have together.
CENTRE_BYTES = 256 << 20
DIGITS = 9


@dataclass(frozen=True)
class Centres:
    """Coarse centres, and the fine ones of each of them."""

    coarse: np.ndarray
    fine: tuple[np.ndarray, ...]
    width: int  # numbers that each coarse cell has for its fine cells

    @property
    def cells(self) -> int:
        return len(self.coarse) * self.width

    def nearest_coarse(self, rows: np.ndarray, n: int) -> np.ndarray:
        products = np.round(rows @ self.coarse.T, DIGITS)
        return np.argsort(-products, axis=1, kind="stable")[:, :n]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        coarse = self.nearest_coarse(rows, 1)[:, 0]
        cells = np.empty(len(rows), dtype=np.int64)
        for number in np.unique(coarse):
            own = coarse == number
            products = np.round(rows[own] @ self.fine[number].T, DIGITS)
            cells[own] = number * self.width + products.argmax(axis=1)
        return cells

    def probe(self, rows: np.ndarray, n_coarse: int, n_cells: int) -> list[np.ndarray]:
        """The ``n_cells`` best cells of each row among those of its ``n_coarse`` best coarse ones."""
        coarse = self.nearest_coarse(rows, n_coarse)
        products = [np.round(rows @ fine.T, DIGITS) for fine in self.fine]
        found = []
        for row, numbers in enumerate(coarse):
            numbers = np.sort(numbers)
            cells = np.concatenate([c * self.width + np.arange(len(self.fine[c])) for c in numbers])
            near = np.concatenate([products[c][row] for c in numbers])
            found.append(cells[np.argsort(-near, kind="stable")[:n_cells]])
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _stacked(rows: list) -> np.ndarray:
    return np.array([r["unit"] for r in rows], dtype=np.float64)


def _choose(unit: DataFrame, n_coarse: int, n_fine: int) -> Centres:
    """The first rows in hashed order, of all rows and of each coarse cell."""
    width = unit.select(F.size("unit")).first()
    if width is None:
        raise ValueError("an index needs at least one vector")
    if n_coarse * (n_fine + 1) * width[0] * 8 > CENTRE_BYTES:
        raise ValueError(f"the centres may have {CENTRE_BYTES} bytes together")
    coarse = _stacked(unit.orderBy("hash", "item_id").limit(n_coarse).select("unit").collect())
    first = Centres(coarse, tuple(np.zeros((1, coarse.shape[1])) for _ in coarse), 1)
    # The rank limit is applied before the shuffle, so a hot cell sends n_fine rows a task.
    in_order = Window.partitionBy("cell").orderBy("hash", "item_id")
    rows = (
        _assigned(unit.select("item_id", "hash", "unit"), first)
        .withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= n_fine)
        .select("cell", "nth", "unit").collect()  # at most n_coarse x n_fine
    )
    # A centre whose every row lies nearer to a copy of it has no rows; it stands for itself.
    fine = []
    for number in range(len(coarse)):
        own = sorted((r for r in rows if r["cell"] == number), key=lambda r: r["nth"])
        fine.append(_stacked(own) if own else coarse[number:number + 1])
    return Centres(coarse, tuple(fine), n_fine)


def _assigned(unit: DataFrame, centres: Centres) -> DataFrame:
    """``unit`` with the cell of every row."""
    shipped = unit.sparkSession.sparkContext.broadcast(centres)
    names = unit.columns
    place = names.index("unit")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            cells = shipped.value.assign(_matrix(batch.column(place))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*names, "cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unit.schema)
    return unit.mapInArrow(batches, f"{kinds}, cell bigint")


def _unit(df: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    unit = l2_normalize(F.col("vector").cast("array<double>")).alias("unit")
    return df.select("*", unit) if seed is None else df.select("*", unit, hashed_order(seed, F.col(key)).alias("hash"))


def save_index(index: DataFrame, path: str, n_coarse: int, n_fine: int, seed: int = 42) -> None:
    """Write ``index`` (item_id, position, item_label, vector) by cell, and its centres, below ``path``."""
    unit = _unit(index.select("item_id", "position", "item_label", "vector"), "item_id", seed)
    centres = _choose(unit, n_coarse, n_fine)
    placed = _assigned(unit.drop("hash"), centres).drop("unit")
    # Cells are brought together to write few files; a crowded one is split between tasks.
    placed.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    rows = [
        (number, own.tolist(), fine.tolist(), centres.width)
        for number, (own, fine) in enumerate(zip(centres.coarse, centres.fine, strict=True))
    ]
    schema = "coarse int, centre array<double>, fine array<array<double>>, width int"
    index.sparkSession.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/centres")


@dataclass(frozen=True)
class SavedIndex:
    """A table of vectors by cell, and the centres that lead to its cells."""

    vectors: DataFrame
    centres: Centres

    def probe(self, queries: DataFrame, n_coarse: int, n_cells: int) -> DataFrame:
        """query_id, vector and cell: each query once for every cell that it probes."""
        shipped = queries.sparkSession.sparkContext.broadcast(self.centres)

        def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                rows = _matrix(batch.column(2))
                found = shipped.value.probe(rows, n_coarse, n_cells) if len(batch) else []
                cells = pa.array([x.tolist() for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], cells], names=["query_id", "vector", "cells"])

        kind = queries.schema["vector"].dataType.simpleString()
        probed = _unit(queries.select("query_id", "vector"), "query_id").mapInArrow(
            batches, f"query_id string, vector {kind}, cells array<bigint>"
        )
        return probed.select("query_id", "vector", F.explode("cells").alias("cell"))

    def topk(self, queries: DataFrame, k: int, n_coarse: int, n_cells: int) -> DataFrame:
        """Exact top-k of ``queries`` (query_id, vector) within the cells that each probes."""
        probes = cut_lineage(self.probe(queries, n_coarse, n_cells))
        # The distinct cells are no more than the centres. They prune the table's folders.
        wanted = [row[0] for row in probes.select("cell").distinct().collect()]
        return cell_topk(probes, self.vectors.where(F.col("cell").isin(wanted)), k)


def load_index(spark: SparkSession, path: str) -> SavedIndex:
    """Open an index that ``save_index`` wrote."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("coarse").collect()
    centres = Centres(
        np.array([r["centre"] for r in rows]), tuple(np.array(r["fine"]) for r in rows), rows[0]["width"]
    )
    vectors = spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("bigint"))
    return SavedIndex(vectors, centres)
