"""Patch metadata and footprint inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitrank.functions import geo
from orbitrank.operators.checks import duplicates
from orbitrank.operators.frames import stack

METADATA_SCHEMA = T.StructType([
    T.StructField("patch_id", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("split", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("s1_name", T.StringType()),
    T.StructField("s2v1_name", T.StringType()),
    T.StructField("contains_seasonal_snow", T.BooleanType()),
    T.StructField("contains_cloud_or_shadow", T.BooleanType()),
])
# The publisher's id format.
PATCH_PATTERN = r"^S2[AB]_MSIL2A_(\d{8}T\d{6})_N\d{4}_R\d{3}_T(\d{2}[A-Z]{3})_(\d{2})_(\d{2})$"


def read_metadata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Scan patch metadata, refusing files that lack a required column."""
    paths = [path] if isinstance(path, str) else list(path)
    found = spark.read.parquet(*paths)
    missing = [f.name for f in METADATA_SCHEMA if f.name not in found.columns]
    if missing:
        raise ValueError(f"metadata lacks required columns: {', '.join(missing)}")
    return found.select(*[f.name for f in METADATA_SCHEMA])


def parse_patch_id(patch_id: Column) -> dict[str, Column]:
    """Date, tile, row, column and grid key; NULL where the id is malformed."""
    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(patch_id, PATCH_PATTERN, i), F.lit(""))

    stamp = F.try_to_timestamp(group(1), F.lit("yyyyMMdd'T'HHmmss"))
    return {
        "acquisition_day": stamp.cast("date"),
        "tile": group(2),
        "row": group(3).cast("int"),
        "column": group(4).cast("int"),
        "grid": F.concat(group(2), F.lit("_"), group(3), F.lit("_"), group(4)),
    }


def identities(recommended: DataFrame, excluded: DataFrame) -> DataFrame:
    """Every id of both metadata files with how often each file holds it."""
    both = stack(
        recommended.select("patch_id", F.lit(1).alias("r"), F.lit(0).alias("e")),
        excluded.select("patch_id", F.lit(0).alias("r"), F.lit(1).alias("e")),
    )
    return both.groupBy("patch_id").agg(F.sum("r").alias("recommended"), F.sum("e").alias("excluded"))


def identity_violations(found: DataFrame) -> DataFrame:
    """Ids repeated inside a file or present in both."""
    rule = F.when((F.col("recommended") > 0) & (F.col("excluded") > 0), "in_both_files").when(
        (F.col("recommended") > 1) | (F.col("excluded") > 1), "duplicate_patch_id"
    )
    return found.select(rule.alias("rule"), F.col("patch_id").alias("key")).filter("rule IS NOT NULL")


def add_centers(footprints: DataFrame) -> DataFrame:
    """Centre longitude, latitude and equal-area cell of native UTM squares."""
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("bottom") + F.col("top")) / 2
    placed = geo.add_lonlat(footprints, F.col("epsg"), x, y)
    return placed.withColumn("spatial_group", geo.lonlat_cell(F.col("longitude"), F.col("latitude")))


def write_inventory(footprints: DataFrame, path: str) -> None:
    """Zstandard Parquet inventory with centres and cells; refuses an existing path."""
    add_centers(footprints).write.option("compression", "zstd").mode("errorifexists").parquet(path)


def crs_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("epsg").agg(F.count(F.lit(1)).alias("patches"))


def coverage_violations(metadata: DataFrame, inventory: DataFrame) -> DataFrame:
    """Ids the inventory repeats, lacks or has too many of."""
    ids = metadata.select("patch_id", F.lit(True).alias("__m")).distinct()
    other = inventory.select("patch_id", F.lit(True).alias("__i")).distinct()
    joined = ids.join(other, "patch_id", "full_outer")
    rule = F.when(F.col("__i").isNull(), "missing_footprint").when(F.col("__m").isNull(), "foreign_footprint")
    uncovered = joined.select(rule.alias("rule"), F.col("patch_id").alias("key")).filter("rule IS NOT NULL")
    return stack(uncovered, duplicates(inventory, "patch_id", "repeated_footprint"))


def join_candidates(metadata: DataFrame, inventory: DataFrame) -> DataFrame:
    """Metadata rows with their geometry, one to one."""
    return metadata.join(inventory, "patch_id")


def frozen_inputs(metadata: DataFrame, selection: DataFrame) -> DataFrame:
    """Metadata of selected ids only: pruned columns and a semi join."""
    return metadata.select("patch_id", "labels", "split").join(
        selection.select("patch_id"), "patch_id", "left_semi"
    )
