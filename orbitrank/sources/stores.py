"""Embedding stores, projections and relevance manifests on disk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitrank.operators.checks import Rule, duplicates, violations
from orbitrank.operators.frames import stack

# The tag a relevance file must carry, and the backends a run log names.
RELEVANCE_TAG = "eo-multilabel-relevance-v1"
KNOWN_BACKENDS = ("pca", "dinov2", "ssl4eo-s12", "terramind")

META_SCHEMA = T.StructType([
    T.StructField("store", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("manifest_sha256", T.StringType()),
    T.StructField("image_size", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
RELEVANCE_SCHEMA = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("image_manifest_sha256", T.StringType()),
    T.StructField("records", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("partition", T.StringType()),
    ]))),
])


def save_store(store: DataFrame, path: str, meta: Mapping[str, str] | None = None) -> None:
    """Write vectors, labels and splits; NULL labels stay NULL."""
    store.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode(
        "overwrite"
    ).parquet(f"{path}/rows")
    facts = dict(meta or {})
    row = (
        facts.pop("store", "store"), facts.pop("backend", None), facts.pop("model", None),
        facts.pop("manifest_sha256", None),
        int(facts.pop("image_size")) if "image_size" in facts else None, facts,
    )
    store.sparkSession.createDataFrame([row], META_SCHEMA).write.mode("overwrite").json(f"{path}/meta")


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and the one-row description of a saved store."""
    return spark.read.parquet(f"{path}/rows"), spark.read.schema(META_SCHEMA).json(f"{path}/meta")


def legacy_labels(store: DataFrame) -> DataFrame:
    """Old stores mark a missing label by an empty string."""
    return store.withColumn("label", F.nullif("label", F.lit("")))


def store_violations(store: DataFrame) -> DataFrame:
    """Repeated ids, unknown splits, and vectors of another width than the first by position."""
    width = store.groupBy(F.size("embedding").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("position")
    )
    odd = width.agg(F.min_by("width", "position").alias("first"), F.count(F.lit(1)).alias("widths")).filter(
        "widths > 1"
    ).select(F.lit("mixed_dimensions").alias("rule"), F.col("first").cast("string").alias("key"))
    rows = violations(
        store, "item_id",
        [Rule("unknown_split", ~F.coalesce(F.col("split").isin("index", "query"), F.lit(False)))],
    )
    return stack(rows, duplicates(store, "item_id", "duplicate_item_id"), odd)


def run_metadata(manifest: DataFrame, manifest_sha256: str) -> DataFrame:
    """Item counts by split beside the manifest hash."""
    return manifest.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("split") == "index").alias("index_items"),
        F.count_if(F.col("split") == "query").alias("query_items"),
    ).withColumn("manifest_sha256", F.lit(manifest_sha256))


def save_projection(spark: SparkSession, path: str, mean, components, **facts) -> None:
    """One row holding the mean and components of a fitted projection."""
    schema = (
        "store string, mean array<float>, components array<array<float>>, "
        "image_size int, seed int, manifest_sha256 string, dimension int"
    )
    row = (
        facts.get("store"), [float(x) for x in mean], [[float(x) for x in c] for c in components],
        facts.get("image_size"), facts.get("seed"), facts.get("manifest_sha256"), len(components),
    )
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(path)


def load_projection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def projection_shape_violations(projection: DataFrame) -> DataFrame:
    """A projection's components must match its mean and its image size."""
    features = F.size("mean")
    return violations(
        projection.withColumn("key", F.coalesce("store", F.lit("projection"))), "key",
        [
            Rule("component_width", F.exists("components", lambda c: F.size(c) != features)),
            Rule("image_size_too_small", F.col("image_size") < 8),
            Rule("feature_count", features != F.col("image_size") * F.col("image_size") * 3),
        ],
    )


def read_relevance(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header row and exploded judgments of a relevance file."""
    document = spark.read.schema(RELEVANCE_SCHEMA).option("multiLine", True).json(path)
    records = document.select(F.explode("records").alias("r")).select("r.*")
    return document.drop("records"), records


def write_relevance(records: DataFrame, path: str, dataset: str, manifest_sha256: str) -> None:
    """Relevance rows as JSON lines under a header file with the schema tag."""
    spark = records.sparkSession
    header = [(RELEVANCE_TAG, dataset, manifest_sha256)]
    spark.createDataFrame(header, "schema string, dataset string, image_manifest_sha256 string").write.mode(
        "overwrite").json(f"{path}/header")
    records.write.mode("overwrite").json(f"{path}/records")


def read_relevance_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header and rows of a relevance folder written by ``write_relevance``."""
    header = spark.read.schema("schema string, dataset string, image_manifest_sha256 string").json(f"{path}/header")
    rows = spark.read.schema("item_id string, labels array<string>, partition string").json(f"{path}/records")
    return header, rows


def relevance_record_violations(records: DataFrame) -> DataFrame:
    """Ids, partitions and label lists of relevance rows."""
    labels = F.col("labels")
    rows = violations(
        records, "item_id",
        [
            Rule("empty_item_id", F.coalesce("item_id", F.lit("")) == ""),
            Rule("unknown_partition",
                 ~F.coalesce(F.col("partition").isin("index", "development", "final"), F.lit(False))),
            Rule("labels_not_sorted_unique", labels != F.array_sort(F.array_distinct(labels))),
            Rule("blank_label", F.exists(labels, lambda x: x.isNull() | (F.trim(x) == ""))),
            Rule("unlabeled_index_item", (F.col("partition") == "index") & (F.size(labels) == 0)),
        ],
    )
    return stack(rows, duplicates(records, "item_id", "duplicate_item_id"))


def provenance(stores: DataFrame, meta: DataFrame) -> DataFrame:
    """What is known about each store, with fallbacks for what was not recorded."""
    counts = stores.groupBy("store").agg(F.count_if(F.col("split") == "index").alias("index_items"))
    return meta.join(counts, "store").select(
        "store",
        F.coalesce("model", "store").alias("model"),
        F.coalesce("backend", F.lit("unknown")).alias("backend"),
        "index_items",
        F.lit("exact-cosine").alias("ranker"),
        "manifest_sha256",
        F.col("metadata")["checkpoint_sha256"].alias("checkpoint_sha256"),
        F.coalesce(F.array_join(F.from_json(F.col("metadata")["bands"], "array<string>"), ", "),
                   F.lit("RGB")).alias("input"),
    )


def query_picker(store: DataFrame) -> DataFrame:
    """Query ids under their label; one row per query, so no label gathers a list."""
    return store.filter(F.col("split") == "query").select(
        F.coalesce("label", F.lit("Unlabelled")).alias("label"), F.col("item_id").alias("query_id")
    )
