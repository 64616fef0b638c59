"""Audit of patch metadata: rules, label, date, country and grid statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrank.operators.checks import Rule, duplicates, violations
from orbitrank.operators.frames import stack
from orbitrank.sources.patches import PATCH_PATTERN, parse_patch_id

SPLITS = ("train", "validation", "test")


def metadata_violations(rows: DataFrame, excluded: bool) -> DataFrame:
    """Malformed ids, unknown splits, bad labels or names, flags against the file."""
    def blank(column: str) -> F.Column:
        return F.coalesce(F.trim(column), F.lit("")) == ""

    labels = F.col("labels")
    flags = F.col("contains_seasonal_snow") | F.col("contains_cloud_or_shadow")
    found = violations(
        rows, "patch_id",
        [
            Rule("invalid_patch_id", ~F.coalesce(F.col("patch_id").rlike(PATCH_PATTERN), F.lit(False))
                 | parse_patch_id(F.col("patch_id"))["acquisition_day"].isNull()),
            Rule("unknown_split", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))),
            Rule("bad_labels", labels.isNull() | (F.size(labels) == 0)
                 | F.exists(labels, lambda x: x.isNull() | (F.trim(x) == ""))),
            Rule("duplicate_label", F.size(F.array_distinct(labels)) != F.size(labels)),
            Rule("blank_country", blank("country")),
            Rule("blank_s1_name", blank("s1_name")),
            Rule("blank_s2v1_name", blank("s2v1_name")),
            Rule("missing_flag", F.col("contains_seasonal_snow").isNull()
                 | F.col("contains_cloud_or_shadow").isNull()),
            Rule("flags_disagree_with_file", flags != F.lit(excluded)),
        ],
    )
    return stack(found, duplicates(rows, "patch_id", "duplicate_patch_id"))


def parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumns(parse_patch_id(F.col("patch_id")))


def summary(rows: DataFrame) -> DataFrame:
    """Totals per split and overall (NULL split): rows, dates, tiles and flags."""
    snow, cloud = F.col("contains_seasonal_snow"), F.col("contains_cloud_or_shadow")
    return parsed(rows).groupingSets([[], [F.col("split")]], "split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("acquisition_day").alias("date_min"),
        F.max("acquisition_day").alias("date_max"),
        F.count_distinct("acquisition_day").alias("unique_acquisition_dates"),
        F.count_distinct("tile").alias("mgrs_tiles"),
        F.count_if(snow).alias("seasonal_snow"),
        F.count_if(cloud).alias("cloud_or_shadow"),
        F.count_if(snow & cloud).alias("both"),
    )


def months(rows: DataFrame) -> DataFrame:
    month = F.date_format("acquisition_day", "yyyy-MM").alias("month")
    return parsed(rows).groupBy("split", month).agg(F.count(F.lit(1)).alias("rows"))


def countries(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "country").agg(F.count(F.lit(1)).alias("rows"))


def label_counts(rows: DataFrame) -> DataFrame:
    """Rows per label and split; every label appears in every split, zeros included."""
    counted = rows.select("split", F.explode("labels").alias("label")).groupBy("label").pivot(
        "split", list(SPLITS)
    ).count()
    filled = counted.fillna(0, list(SPLITS))
    return filled.unpivot(["label"], list(SPLITS), "split", "rows")


def shared_dates(rows: DataFrame) -> DataFrame:
    """Acquisition dates each pair of splits has in common."""
    per_day = parsed(rows).groupBy("acquisition_day").pivot("split", list(SPLITS)).count()
    def both(a: str, b: str) -> F.Column:
        return F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}/{b}")

    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    counted = per_day.agg(*[both(a, b) for a, b in pairs])
    return counted.unpivot([], [f"{a}/{b}" for a, b in pairs], "pair", "dates")


def grid_identity(rows: DataFrame) -> DataFrame:
    """Grid keys, and how many recur in several splits or on several dates."""
    keys = parsed(rows).groupBy("grid").agg(
        F.min("split").alias("s1"), F.max("split").alias("s2"),
        F.min("acquisition_day").alias("d1"), F.max("acquisition_day").alias("d2"),
    )
    return keys.agg(
        F.count(F.lit(1)).alias("unique_keys"),
        F.count_if(F.col("s1") != F.col("s2")).alias("keys_in_multiple_splits"),
        F.count_if(F.col("d1") != F.col("d2")).alias("keys_on_multiple_dates"),
    )
