"""Claims that depend on earlier ones, in rounds of top-k, prefix sums and minima.

Labels are served one after another, the rarest first. What a label takes depends on the
labels before it only through the counts reached so far, so one round settles a whole
label, however many rows it takes:

* Of cells, the one that brings most of what is lacking comes next. While the richest
  open cell brings less than is lacking, that is the order of falling counts, so the
  cells taken whole are a prefix that a running sum ends. The last one is the first in
  hashed order that brings all the rest.
* Of single rows, the first ones in hashed order are taken that are still free.

Rows stay in Spark; the driver holds only the names that were taken, at most labels x
minimum of them, and a count for each label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a label domain may have.
MOST_LABELS = 10_000


def label_domain(rows: DataFrame) -> list[str]:
    """The sorted labels of ``rows`` (labels)."""
    found = rows.select(F.explode("labels").alias("label")).distinct().limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    return sorted(row[0] for row in found)


def label_totals(rows: DataFrame) -> Counter:
    """How many of ``rows`` hold each label."""
    counts = rows.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)))
    return Counter(dict(map(tuple, counts.limit(MOST_LABELS).collect())))


def rare_first(labels: Iterable[str], totals: Counter) -> list[str]:
    """Labels from the rarest on, by name where equally rare."""
    return sorted(labels, key=lambda name: (totals[name], name))


def cell_gains(rows: DataFrame) -> DataFrame:
    """spatial_group, n and gains (rows per label) of every cell of ``rows``."""
    sizes = rows.groupBy("spatial_group").agg(F.count(F.lit(1)).alias("n"))
    # A cell gathers one entry for each of its labels.
    gains = (
        rows.select("spatial_group", F.explode("labels").alias("label"))
        .groupBy("spatial_group", "label").agg(F.count(F.lit(1)).alias("count"))
        .groupBy("spatial_group").agg(F.map_from_entries(F.collect_list(F.struct("label", "count"))).alias("gains"))
    )
    return sizes.join(gains, "spatial_group", "left")


def _open(cells: DataFrame, label: str, taken: Sequence[str]) -> DataFrame:
    brings = F.coalesce(F.try_element_at("gains", F.lit(label)), F.lit(0))
    left = cells.withColumn("brings", brings).where(F.col("brings") > 0)
    return left.where(~F.col("spatial_group").isin(list(taken))) if taken else left


def claim_cells(cells: DataFrame, order: str, labels: Sequence[str], minimum: int) -> list[str]:
    """Cells that ``labels``, in this order, claim until each has ``minimum`` rows.

    cells: spatial_group, ``order`` and gains. Raises if a label's open cells hold too few.
    """
    taken: list[str] = []
    have: Counter = Counter()

    def take(rows: list) -> None:
        for row in rows:
            taken.append(row["spatial_group"])
            have.update(row["gains"])

    for label in labels:
        lack = minimum - have[label]
        if lack <= 0:
            continue
        # A cell brings at least one row, so no more than ``lack`` cells are ever needed.
        richest = _open(cells, label, taken).orderBy(F.col("brings").desc(), order).limit(lack)
        before = Window.orderBy(F.col("brings").desc(), order).rowsBetween(Window.unboundedPreceding, -1)
        walked = richest.withColumn("lack", lack - F.coalesce(F.sum("brings").over(before), F.lit(0)))
        take(walked.where(F.col("brings") < F.col("lack")).select("spatial_group", "gains").collect())
        lack = minimum - have[label]
        enough = _open(cells, label, taken).where(F.col("brings") >= lack)
        last = enough.agg(F.min_by(F.struct("spatial_group", "gains"), order).alias("cell")).first()["cell"]
        if last is None:
            raise ValueError(f"too few patches of label {label} in cells that are still free")
        take([last])
    return taken


def top_up(
    pool: DataFrame, free: Column, key: str, order: str, labels: Sequence[str], have: Counter, minimum: int
) -> list[str]:
    """Keys of free rows that ``labels``, in this order, add until each has ``minimum``.

    ``have`` counts the rows taken before. A label takes its first free rows in ``order``.
    """
    have, added = Counter(have), []
    for label in labels:
        short = minimum - have[label]
        if short <= 0:
            continue
        left = pool.where(free & F.array_contains("labels", label))
        if added:
            left = left.where(~F.col(key).isin(added))
        rows = left.orderBy(order).limit(short).select(key, "labels").collect()
        if len(rows) < short:
            raise ValueError(f"label {label} has too few patches in the chosen cells")
        for row in rows:
            added.append(row[key])
            have.update(row["labels"])
    return added
