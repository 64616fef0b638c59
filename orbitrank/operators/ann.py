"""Approximate top-k by inverted cells or random hyperplanes, and corpus expansion."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitrank.functions.vectors import l2_normalize
from orbitrank.operators.metrics import ann_recall
from orbitrank.operators.topk import CHUNK_ROWS, keyed_topk, merge_best

CENTRE_LIMIT = 65_536


def _chunked(df: DataFrame, key: str, sizes: DataFrame, mine: str, other: str, own: str, cross: str) -> DataFrame:
    """Spread a side over its own chunks of a cell and repeat it over the other side's."""
    joined = df.join(sizes, "cell")
    return joined.withColumn(own, F.pmod(F.xxhash64(key), F.col(mine))).withColumn(
        cross, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))
    ).drop(mine, other)


def cell_topk(
    probes: DataFrame, index: DataFrame, k: int, chunk_rows: int = CHUNK_ROWS,
    exclude_self: bool = True, overlapping: bool = False,
) -> DataFrame:
    """Exact top-k among the index rows of each query's probed cells.

    ``overlapping`` says an index row may lie in several cells. Both sides carry ``cell``. A crowded cell is cut into chunks on both sides, so
    no group exceeds a chunk however skewed the cells are.
    """
    def chunks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias(name))

    sizes = chunks(index, "n_col").join(chunks(probes, "n_row"), "cell")
    left = _chunked(probes, "query_id", sizes, "n_row", "n_col", "row", "col")
    right = _chunked(index, "item_id", sizes, "n_col", "n_row", "col", "row")
    partial = keyed_topk(left, right, ["cell", "row", "col"], k, exclude_self)
    if overlapping:
        partial = partial.dropDuplicates(["query_id", "item_id"])
    return merge_best(partial, k)


class CellIndex:
    """k-means cells over unit vectors; queries probe the nearest few."""

    def __init__(self, index: DataFrame, n_cells: int, seed: int = 42, iterations: int = 10) -> None:
        if n_cells > CENTRE_LIMIT:
            raise ValueError(f"at most {CENTRE_LIMIT} cells can be shipped to the tasks")
        unit = index.withColumn("features", array_to_vector(l2_normalize(F.col("vector"))))
        model = KMeans(k=n_cells, seed=seed, maxIter=iterations, predictionCol="cell").fit(unit.select("features"))
        self.centres = np.asarray(model.clusterCenters())
        self.index = model.transform(unit).drop("features").withColumn("cell", F.col("cell").cast("bigint"))

    def probe(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """Repeat each query once per probed cell, nearest centres first."""
        shipped = queries.sparkSession.sparkContext.broadcast(self.centres)
        n = min(nprobe, len(self.centres))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shipped.value
            squares = (centres * centres).sum(axis=1)
            for batch in batches:
                column = batch.column("vector")
                rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                rows = rows.reshape(len(column), -1) if len(column) else np.empty((0, centres.shape[1]))
                rows = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                order = np.argsort(squares[None, :] - 2 * rows @ centres.T, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), column, pa.array(order.astype(np.int64).tolist(), pa.list_(pa.int64()))],
                    names=["query_id", "vector", "cells"],
                )

        vector_type = queries.schema["vector"].dataType.simpleString()
        probed = queries.select("query_id", "vector").mapInArrow(
            nearest, f"query_id string, vector {vector_type}, cells array<bigint>"
        )
        return probed.select("query_id", "vector", F.explode("cells").alias("cell"))

    def topk(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        return cell_topk(self.probe(queries, nprobe), self.index, k)

    def candidate_fraction(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """Mean share of the index a query is compared with."""
        sizes = self.index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        total = self.index.count()
        seen = self.probe(queries, nprobe).select("query_id", "cell").join(sizes, "cell", "left")
        per_query = seen.groupBy("query_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        return per_query.agg((F.avg("n") / F.lit(total)).alias("candidate_fraction"))


def hyperplane_bucket(vector: Column, dimension: int, bits: int, seed: int, table: int) -> Column:
    """Sign pattern of a vector against ``bits`` seeded random hyperplanes."""
    planes = np.random.default_rng([seed, table]).normal(size=(bits, dimension))
    bucket = F.lit(0).cast("bigint")
    for i, plane in enumerate(planes):
        weights = F.array(*[F.lit(float(w)) for w in plane])
        side = F.aggregate(
            F.zip_with(vector.cast("array<double>"), weights, lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x
        )
        bucket = bucket + F.when(side >= 0, F.lit(2**i)).otherwise(F.lit(0))
    return bucket


def hyperplane_topk(
    queries: DataFrame, index: DataFrame, k: int, dimension: int, bits: int = 4, tables: int = 4, seed: int = 42
) -> DataFrame:
    """Top-k among rows sharing a hyperplane bucket in any table."""
    def bucketed(df: DataFrame) -> DataFrame:
        found = [
            (F.lit(t * 2**bits).cast("bigint") + hyperplane_bucket(F.col("vector"), dimension, bits, seed, t))
            for t in range(tables)
        ]
        return df.withColumn("cell", F.explode(F.array(*found)))

    return cell_topk(bucketed(queries.select("query_id", "vector")), bucketed(index), k, overlapping=True)


def sweep(
    queries: DataFrame, index: DataFrame, exact: DataFrame, k: int, n_cells: int, probes: Sequence[int], seed: int = 42
) -> DataFrame:
    """Recall, compared share and batch seconds for each number of probed cells."""
    spark = queries.sparkSession
    started = time.perf_counter()
    cells = CellIndex(index, n_cells, seed)
    build = time.perf_counter() - started
    rows = []
    for nprobe in probes:
        started = time.perf_counter()
        recall = ann_recall(exact, cells.topk(queries, k, nprobe), k).first()
        seconds = time.perf_counter() - started
        share = cells.candidate_fraction(queries, nprobe).first()[0]
        rows.append((nprobe, recall["queries"], float(recall["recall_at_k"]), float(share), build, seconds))
    return spark.createDataFrame(
        rows, "nprobe int, queries bigint, recall_at_k double, candidate_fraction double, "
        "build_seconds double, batch_seconds double",
    )


def expand_corpus(
    store: DataFrame, base_rows: int, target_size: int, dimension: int, seed: int, noise_std: float
) -> DataFrame:
    """Keep the base and add noisy, renormalised copies up to ``target_size`` rows.

    Copies cycle through base positions. The noise of a component is a Box-Muller
    draw from hashes of (seed, row, component): the same whatever the partitioning.
    """
    if target_size < base_rows:
        raise ValueError("target_size must be at least the base size")
    if noise_std <= 0:
        raise ValueError("noise needs a spread above zero")
    base = store.select("position", l2_normalize(F.col("embedding")).alias("embedding"))
    ids = store.sparkSession.range(base_rows, target_size).withColumnRenamed("id", "new_position")
    copies = ids.withColumn("position", F.pmod(F.col("new_position") - base_rows, F.lit(base_rows))).join(
        base, "position"
    )

    def uniform(stream: int, j: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), F.col("new_position"), j), 11)
        return (bits + 0.5) / F.lit(float(2**53))

    def draw(j: Column) -> Column:
        return F.sqrt(-2 * F.log(uniform(0, j))) * F.cos(2 * np.pi * uniform(1, j))

    noise = F.transform(F.sequence(F.lit(1), F.lit(dimension)), draw)
    noisy = F.zip_with("embedding", noise, lambda x, z: x + z * noise_std)
    extra = copies.select(F.col("new_position").alias("position"), noisy.alias("noisy")).select(
        "position", l2_normalize(F.col("noisy")).alias("embedding")
    )
    return base.unionByName(extra)
