"""Structured Streaming versions of ingest, de-duplication, scoring and monitoring.

Every job writes one folder per micro-batch with ``overwrite``, so a batch replayed
after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from orbitrank.functions.hashing import content_sha256
from orbitrank.operators.topk import exact_topk


def read_parquet_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def start_batches(
    stream: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int], DataFrame] | None = None,
    mode: str = "append", available_now: bool = True,
) -> StreamingQuery:
    """Write every micro-batch below ``path`` as ``batch_id=<n>``."""
    def save(batch: DataFrame, batch_id: int) -> None:
        rows = write(batch, batch_id) if write else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(query: StreamingQuery) -> None:
    """Wait for everything available to be processed."""
    query.awaitTermination()
    failed = query.exception()
    if failed is not None:
        raise failed


def score_stream(queries: DataFrame, index: DataFrame, k: int, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rank arriving queries against a static index."""
    carried = [c for c in queries.columns if c not in ("query_id", "vector")]

    def rank(batch: DataFrame, _: int) -> DataFrame:
        hits = exact_topk(batch.select("query_id", "vector"), index, k)
        return hits.join(batch.select("query_id", *carried), "query_id") if carried else hits

    return start_batches(queries, path, checkpoint, rank, available_now=available_now)


def day_dedupe_stream(items: DataFrame, late_after: str | None) -> DataFrame:
    """Least cloudy item per place and day so far. ``items`` has (place_id, ts, cloud, item_id).

    ``late_after`` is the policy for late items: with None every item counts whenever it
    comes, so the answer does not depend on how a bounded table is cut into files and
    batches, and a row of state stays for each place and day; with a delay, items behind
    the watermark are dropped and their days leave the state.
    """
    order = F.struct(F.coalesce("cloud", F.lit(float("inf"))), F.col("ts"), F.col("item_id"))
    return (
        (items if late_after is None else items.withWatermark("ts", late_after))
        .groupBy("place_id", F.window("ts", "1 day"))
        .agg(F.min_by(F.struct("item_id", "cloud", "ts"), order).alias("row"), F.count(F.lit(1)).alias("items_that_day"))
        .select("place_id", F.to_date("window.start").alias("acquisition_day"), "row.*", "items_that_day")
    )


def latest(path: str, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Newest version of every key an update-mode job wrote."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def unique_within_watermark(items: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a content hash that arrive within the watermark."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha256"])


def ingest_stream(items: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep each content once, under the lowest id that it ever came with.

    ``items`` has (item_id, content). The lowest id of every content is kept as keyed
    state; each batch writes the contents whose id is new or lower, and ``latest`` with
    key ``sha256`` reads what holds. No batch reads what earlier ones wrote.
    """
    lowest = items.select(content_sha256(F.col("content")).alias("sha256"), "item_id").groupBy("sha256").agg(
        F.min("item_id").alias("item_id")
    )
    return start_batches(lowest, path, checkpoint, mode="update", available_now=available_now)


def precision_monitor(hits: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Share of relevant hits per tumbling window. ``hits`` has (ts, query_id, relevant)."""
    return (
        hits.withWatermark("ts", delay)
        .groupBy(F.window("ts", width))
        .agg(F.avg("relevant").alias("precision_at_k"), F.count(F.lit(1)).alias("hits"))
        .select(F.col("window.start").alias("window_start"), "precision_at_k", "hits")
    )
