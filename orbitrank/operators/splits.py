"""Content-hash and spatial-cell index/query splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitrank.functions.hashing import hashed_order
from orbitrank.operators.frames import null_safe_join
from orbitrank.operators.ranking import bucketed_rank, hashed_rank
from orbitrank.session import cut_lineage

# The planner limits a ranking window before its shuffle only up to this rank.
MAP_SIDE_LIMIT = 1_000
# Labels whose last query hashes are shipped to the tasks; of more, they are joined by label.
SHIPPED_LABELS = 100_000


def query_quota(size: Column, fraction: float) -> Column:
    """How many of ``size`` hashes become queries: half-even, at least 1, never all."""
    wanted = F.bround(size * F.lit(fraction)).cast("bigint")
    return F.when(
        size >= 2, F.greatest(F.lit(1).cast("bigint"), F.least(size - 1, wanted))
    ).otherwise(F.lit(0))


def hash_split(
    df: DataFrame, key: str, label: str = "label", fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: per label, the first hashes in seeded order become queries.

    Copies share their key, so they share a split. A missing key comes last, so it is
    never a query. Only the hash at which a label's
    quota ends is looked for: distinct hashes are counted per label and hash prefix,
    the prefix where the quota ends is ranked, and every row is then compared with
    its label's last query hash. No label is ever sorted whole.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")

    def in_order(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), hashed_order(seed, F.col(name))).otherwise("~")

    def hashed(rows: DataFrame) -> DataFrame:
        order = in_order("__key")
        return rows.withColumn("__order", order).withColumn("__prefix", F.substring("__order", 1, 3))

    keys = df.select(F.col(label).alias("__label"), F.col(key).alias("__key"))
    counts = hashed(keys.distinct()).groupBy("__label", "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    over_label = Window.partitionBy("__label")
    earlier = over_label.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({
        "__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
        "__quota": query_quota(F.sum("__n").over(over_label), fraction),
    })
    ends = placed.filter(
        (F.col("__before") < F.col("__quota")) & (F.col("__quota") <= F.col("__before") + F.col("__n"))
    ).select("__label", "__prefix", (F.col("__quota") - F.col("__before")).alias("__need"))
    inside = null_safe_join(hashed(keys), ends, ["__label", "__prefix"]).distinct()
    nth = F.row_number().over(over_label.orderBy("__order"))
    last = inside.withColumn("__nth", nth).filter(F.col("__nth") == F.col("__need"))
    last = cut_lineage(last.select(F.col("__label").alias(label), F.col("__order").alias("__last")))
    # A row for each label: counted, and shipped so that the rows themselves stay where they are.
    if last.count() <= SHIPPED_LABELS:
        last = F.broadcast(last)
    query = F.coalesce(in_order(key) <= F.col("__last"), F.lit(False))
    return (
        null_safe_join(df, last, [label], "left")
        .withColumn("split", F.when(query, "query").otherwise("index"))
        .drop("__last")
    )


def query_cells(
    candidates: DataFrame, queries_per_class: int, seed: int, labels: Sequence[str] | None = None
) -> DataFrame:
    """Cells given to the query side, with what each label had before them.

    A cell is kept iff one of its labels is still short of its candidate or cell
    target. While a label is short every earlier cell holding it was kept, so
    plain prefix sums per label give the same answer as walking the cells. The
    windows run over (label, cell) counts, of which geography allows only as many
    as there are cells, never over candidates.
    """
    if labels is not None:
        candidates = candidates.filter(F.col("label").isin(*labels))
    cells = candidates.groupBy("label", "spatial_group").agg(F.count(F.lit(1)).alias("n"))
    ordered = cells.withColumn(
        "cell_order", hashed_order(seed, "query-groups", F.col("spatial_group"))
    )
    before = (
        Window.partitionBy("label")
        .orderBy("cell_order")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    short = (F.coalesce(F.sum("n").over(before), F.lit(0)) < queries_per_class) | (
        F.count(F.lit(1)).over(before) < min(10, queries_per_class)
    )
    return (
        ordered.withColumn("short", short)
        .groupBy("spatial_group")
        .agg(F.max("short").alias("kept"), F.sum("n").alias("candidates"))
        .filter("kept")
        .drop("kept")
    )


def spread_sample(
    candidates: DataFrame, count: int, seed: int, namespace: str, map_side: int = MAP_SIDE_LIMIT
) -> DataFrame:
    """Per label, take ``count`` rows using every cell before reusing one.

    Rows are ranked inside a cell by hash, then by (depth, hashed cell). Small
    counts are limited map-side; larger ones are ranked in hash buckets.
    """
    name = F.concat(F.lit(f"{namespace}:"), F.col("label"))
    hashed = candidates.withColumns(
        {
            "__order": hashed_order(seed, name, F.col("spatial_group"), F.col("member")),
            "__cell": hashed_order(seed, name, F.col("spatial_group")),
        }
    )
    cell = ["label", "spatial_group"]
    if count <= map_side:
        inside = Window.partitionBy(*cell).orderBy("__order", "member")
        deep = hashed.withColumn("depth", F.row_number().over(inside).cast("bigint"))
    else:
        deep = hashed_rank(hashed, cell, "__order", ["member"], rank="depth", size="__size").drop("__size")
    # Ranked twice below; written once instead of sorting the candidates again.
    deep = cut_lineage(deep.filter(F.col("depth") <= count))
    ranked = bucketed_rank(deep, ["label"], "depth", ["__cell"], rank="pick", size="__all")
    return ranked.filter(F.col("pick") <= count).drop("__order", "__cell", "__all")
