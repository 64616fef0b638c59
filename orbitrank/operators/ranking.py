"""Exact ranks and order statistics that never gather a whole group in one task.

A plain ``row_number`` over a group sends the group to one task. Every helper
here first splits a group into ordered buckets, counts the buckets (a small
aggregate), and ranks inside a bucket only, so one hot group is spread over as
many tasks as it has buckets and the ranks stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitrank.operators.frames import null_safe_join

#: Rows aimed at in a bucket, the most buckets of a group, and how finely its values are sketched.
ROWS_PER_BUCKET, GRID, ACCURACY = 65_536, 1_024, 20_000


def bucketed_rank(
    df: DataFrame,
    groups: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """Rank rows 1..n inside ``groups`` by (bucket, order), with the group size.

    ``bucket`` must be consistent with the wanted order. Rows of a bucket meet in
    one task, rows of a group do not.
    """
    counts = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("__n"))
    over_group = Window.partitionBy(*groups)
    before = over_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns(
        {
            "__before": F.coalesce(F.sum("__n").over(before), F.lit(0)),
            size: F.sum("__n").over(over_group),
        }
    ).drop("__n")
    inside = Window.partitionBy(*groups, bucket).orderBy(*order)
    return (
        null_safe_join(df, offsets, [*groups, bucket])
        .withColumn(rank, F.col("__before") + F.row_number().over(inside))
        .drop("__before")
    )


def hashed_rank(
    df: DataFrame,
    groups: Sequence[str],
    hash_col: str,
    ties: Sequence[str] = (),
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """Rank by a hex digest inside ``groups``.

    The first three hex digits are uniform, so they are 4,096 even buckets.
    """
    bucketed = df.withColumn("__bucket", F.substring(hash_col, 1, 3))
    return bucketed_rank(bucketed, groups, "__bucket", [hash_col, *ties], rank, size).drop("__bucket")


def _splits(values: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per group ``__splits``: the sorted values at which its buckets begin.

    The sketch behind the percentiles merges, so no group is gathered. A group has a
    bucket for every ``ROWS_PER_BUCKET`` of its rows, up to ``GRID``.
    """
    grid = F.percentile_approx(value, [i / GRID for i in range(1, GRID)], ACCURACY)
    sketched = values.groupBy(*groups).agg(grid.alias("__grid"), F.count(F.lit(1)).alias("__n"))
    buckets = F.least(F.ceil(F.col("__n") / ROWS_PER_BUCKET), F.lit(GRID))
    inner = F.when(buckets > 1, F.sequence(F.lit(1), buckets - 1)).otherwise(F.array().cast("array<bigint>"))
    at = F.transform(inner, lambda i: F.get("__grid", (F.floor(i * GRID / buckets) - 1).cast("int")))
    return sketched.select(*groups, F.array_distinct(at).alias("__splits"))


def _value_buckets(values: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Add ``__bucket``, a roughly even split of each group's values, in their order.

    Where the splits lie decides balance only, never a result.
    """
    # How many splits do not exceed the value, found by halving.
    steps = [GRID >> i for i in range(GRID.bit_length())]

    def onward(at: Column, step: Column) -> Column:
        return F.when(F.get("__splits", at + step - 1) <= F.col(value), at + step).otherwise(at)

    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), onward)
    joined = null_safe_join(values, _splits(values, groups, value), groups)
    return joined.withColumn("__bucket", found).drop("__splits")


def running_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value): ``n`` rows, ``below`` smaller rows, ``total`` rows.

    Equal values collapse by partial aggregation first, so a value held by a third
    of all rows costs one row.
    """
    distinct = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    bucketed = _value_buckets(distinct, groups, value)
    sums = bucketed.groupBy(*groups, "__bucket").agg(F.sum("n").alias("__n"))
    over_group = Window.partitionBy(*groups)
    earlier = over_group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *groups,
        "__bucket",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(over_group).alias("total"),
    )
    inside = (
        Window.partitionBy(*groups, "__bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        null_safe_join(bucketed, offsets, [*groups, "__bucket"])
        .withColumn("below", F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .drop("__before", "__bucket")
    )


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float],
    counts: DataFrame | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group: rows of (groups, probability, quantile).

    ``counts`` may hand in the ``running_counts`` of the same rows.
    """
    if counts is None:
        counts = running_counts(df.filter(F.col(value).isNotNull()), groups, value)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    position = F.col("probability") * (F.col("total") - 1)
    placed = counts.select(*groups, value, "n", "below", "total", wanted).withColumn(
        "__position", position
    )
    low, high = F.floor("__position"), F.ceil("__position")
    def holds(p: Column) -> Column:
        return (F.col("below") <= p) & (p < F.col("below") + F.col("n"))

    return (
        placed.filter(holds(low) | holds(high))
        .groupBy(*groups, "probability")
        .agg(
            F.max(F.when(holds(low), F.col(value))).alias("__low"),
            F.max(F.when(holds(high), F.col(value))).alias("__high"),
            F.max(F.col("__position") - low).alias("__part"),
        )
        .select(
            *groups,
            "probability",
            (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias(
                "quantile"
            ),
        )
    )


def value_rank(
    df: DataFrame, groups: Sequence[str], value: str, position: str, rank: str = "rank",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Zero-based rank by (value, position) with ``total`` rows per group.

    Ties on ``value`` are ordered by ``position``; a hot tie is split again into
    ranges of ``position``, so it never becomes one task either.
    """
    if counts is None:
        counts = running_counts(df, groups, value)
    counts = counts.select(*groups, value, F.col("below").alias("__below"), "total")
    ranges = _value_buckets(df, groups, position).withColumnRenamed("__bucket", "__range")
    tied = bucketed_rank(
        ranges, [*groups, value], "__range", [position], rank="__tie", size="__ties"
    )
    return (
        null_safe_join(tied, counts, [*groups, value])
        .withColumn(rank, F.col("__below") + F.col("__tie") - 1)
        .drop("__below", "__tie", "__ties", "__range")
    )
