"""What a prepared benchmark used up, and how far the rest is from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrank.operators.nearest import nearest_distance
from orbitrank.operators.ranking import exact_quantiles


def unknown_members(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Used members that are not among the candidates."""
    return used.select("member").join(candidates.select("member"), "member", "left_anti")


def free_candidates(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates in cells no used member touched."""
    spent = candidates.join(used.select("member"), "member", "left_semi").select("spatial_group").distinct()
    return candidates.join(spent, "spatial_group", "left_anti")


def cell_budget(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Total, used and free patches and cells."""
    marked = candidates.join(
        used.select("member").distinct().withColumn("__used", F.lit(1)), "member", "left"
    )
    cells = marked.groupBy("spatial_group").agg(
        F.count(F.lit(1)).alias("n"), F.count("__used").alias("used")
    )
    free = F.col("used") == 0
    return cells.agg(
        F.sum("n").alias("total_patches"),
        F.count(F.lit(1)).alias("total_cells"),
        F.sum("used").alias("used_patches"),
        F.count_if(~free).alias("used_cells"),
        F.count_if(free).alias("free_cells"),
        F.sum(F.when(free, F.col("n")).otherwise(0)).alias("free_patches"),
    )


def cell_budget_by_label(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Free patches and cells of every label, zeros included."""
    marked = candidates.join(
        used.select("member").distinct().withColumn("__used", F.lit(1)), "member", "left"
    )
    by_cell = marked.groupBy("spatial_group", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count("__used").alias("used")
    )
    spent = by_cell.filter("used > 0").select("spatial_group", F.lit(1).alias("__spent")).distinct()
    free = F.col("__spent").isNull()
    return (
        by_cell.join(spent, "spatial_group", "left")
        .groupBy("label")
        .agg(
            F.sum(F.when(free, F.col("n")).otherwise(0)).alias("free_patches"),
            F.count_if(free).alias("free_cells"),
        )
    )


def unused_distances(candidates: DataFrame, used: DataFrame, reference: DataFrame) -> DataFrame:
    """Every unused candidate with its metres to the reference points."""
    unused = candidates.join(used.select("member"), "member", "left_anti")
    near = nearest_distance(unused.withColumn("left_id", F.col("member")), reference)
    return unused.join(near.withColumnRenamed("left_id", "member"), "member")


def distance_tiers(
    distances: DataFrame, labels: DataFrame, thresholds_km: Sequence[float]
) -> DataFrame:
    """Survivors per threshold and label: patches and cells, zeros included.

    A candidate counts in every threshold it clears; per cell only its farthest
    candidate matters, so cells are counted after one aggregate per (label, cell).
    """
    if not thresholds_km or any(not t > 0 for t in thresholds_km):
        raise ValueError("thresholds_km must be positive")
    keyed = {f"{t:g}km": float(t) * 1000 for t in thresholds_km}
    kept = [F.count_if(F.col("nearest_m") >= m).alias(f"p{i}") for i, m in enumerate(keyed.values())]
    by_cell = distances.groupBy("label", "spatial_group").agg(*kept)
    per_label = by_cell.groupBy("label").agg(
        *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(keyed))],
        *[F.count_if(F.col(f"p{i}") > 0).alias(f"c{i}") for i in range(len(keyed))],
    )
    full = labels.select("label").distinct().join(per_label, "label", "left")
    tiers = F.array(*[
        F.struct(
            F.lit(name).alias("tier"),
            F.coalesce(f"p{i}", F.lit(0)).alias("patches"),
            F.coalesce(f"c{i}", F.lit(0)).alias("cells"),
        )
        for i, name in enumerate(keyed)
    ])
    return full.select("label", F.explode(tiers).alias("t")).select("t.*", "label")


def tier_summary(tiers: DataFrame) -> DataFrame:
    """Total survivors, labels present and the smallest label of every tier."""
    return tiers.groupBy("tier").agg(
        F.sum("patches").alias("total"),
        F.count_if(F.col("patches") > 0).alias("labels_present"),
        F.min("patches").alias("min_label_patches"),
    )


def distance_percentiles(
    distances: DataFrame, percentiles: Sequence[float] = (5, 25, 50, 75, 95)
) -> DataFrame:
    """Percentiles of the nearest distance in km, three decimals."""
    keyed = distances.select((F.col("nearest_m") / 1000).alias("km"), F.lit("all").alias("scope"))
    found = exact_quantiles(keyed, ["scope"], "km", [p / 100 for p in percentiles])
    name = F.concat(F.lit("p"), F.round(F.col("probability") * 100).cast("int").cast("string"))
    return found.select(name.alias("percentile"), F.bround("quantile", 3).alias("km"))
