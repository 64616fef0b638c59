"""Image folders and item manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitrank.functions.hashing import content_sha256
from orbitrank.operators.checks import Rule, enforce, manifest_violations, violations
from orbitrank.operators.splits import hash_split
from orbitrank.session import cut_lineage
from orbitrank.sources.lines import numbered_lines

# File suffixes taken as images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff")

MANIFEST_SCHEMA = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
_CORRUPT = "_corrupt_record"


def _suffix_glob(suffix: str) -> str:
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def read_image_files(spark: SparkSession, root: str, suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """Files below ``root`` as (path, content); other suffixes are never opened."""
    globs = ",".join(_suffix_glob(s) for s in suffixes)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + globs + "}")
        .load(root)
        .select("path", "content")
    )


def image_entries(files: DataFrame, root: str) -> DataFrame:
    """Relative path, content hash and label (first folder, NULL at the root) of each file."""
    stem = root.rstrip("/") + "/"
    inside = F.expr(f"substring(path, instr(path, '{stem}') + {len(stem)})")
    label = F.when(F.instr("item_id", "/") > 0, F.substring_index("item_id", "/", 1))
    return (
        files.select(inside.alias("item_id"), content_sha256(F.col("content")).alias("sha256"))
        .withColumn("label", label)
    )


def build_manifest(
    files: DataFrame, root: str, fraction: float = 0.2, seed: int = 42, strict: bool = True
) -> DataFrame:
    """Scan to manifest: copies share a split, and must share a label.

    ``strict`` raises on the first violation; otherwise check ``manifest_violations``.
    Contents are read and hashed once, into a narrow table that all that follows reads.
    """
    entries = cut_lineage(image_entries(files, root))
    split = hash_split(entries, "sha256", fraction=fraction, seed=seed)
    manifest = split.select(
        "item_id", F.col("item_id").alias("path"), "split", "label",
        F.lit("local").alias("source"), "sha256",
    )
    if strict:
        enforce(manifest_violations(manifest))
    return manifest


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed manifest rows, and the lines that could not be read.

    Blank lines are skipped. A broken line becomes a violation whose key is its file's
    name and its number, instead of failing the scan.
    """
    schema = T.StructType([*MANIFEST_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT})
    rows = lines.withColumn("row", parsed).select(
        F.concat_ws(":", F.substring_index("file", "/", -1), "line").alias("__key"),
        (F.col("row").isNull() | F.col(f"row.{_CORRUPT}").isNotNull()).alias("__broken"), "row.*",
    ).drop(_CORRUPT)
    required = F.col("item_id").isNull() | F.col("path").isNull() | F.col("split").isNull()
    broken = violations(
        rows, "__key",
        [
            Rule("unreadable_line", F.col("__broken")),
            Rule("missing_field", ~F.col("__broken") & required),
        ],
    )
    typed = rows.filter(~F.col("__broken") & ~required).drop("__key", "__broken").withColumn(
        "source", F.coalesce("source", F.lit("local"))
    )
    return typed.withColumn("sha256", F.col("metadata")["sha256"]), broken


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest that is whole: every line readable, at least one, all rules kept."""
    rows, broken = read_manifest(spark, path)
    enforce(broken)
    if rows.isEmpty():
        raise ValueError(f"manifest is empty: {path}")
    enforce(manifest_violations(rows))
    return rows


def write_manifest(manifest: DataFrame, path: str) -> None:
    """JSON lines ordered by id with sorted keys; the commit protocol makes it atomic."""
    ordered = manifest.select(*sorted(manifest.columns)).orderBy("item_id")
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def archive_member_violations(manifest: DataFrame, source: str) -> DataFrame:
    """Foreign sources, missing members and repeated members."""
    from orbitrank.operators.checks import duplicates
    from orbitrank.operators.frames import stack

    rows = violations(
        manifest, "item_id",
        [
            Rule("foreign_source", ~F.col("source").eqNullSafe(F.lit(source))),
            Rule("no_archive_member", F.coalesce("archive_member", F.lit("")) == ""),
        ],
    )
    named = manifest.filter(F.coalesce("archive_member", F.lit("")) != "")
    return stack(rows, duplicates(named, "archive_member", "duplicate_archive_member"))


def sample_per_group(manifest: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` items of every (label, split) by id, items without one last; limited map-side."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("label", "split").orderBy(F.col("item_id").asc_nulls_last())
    return manifest.withColumn("__nth", F.row_number().over(order)).filter(
        F.col("__nth") <= n
    ).drop("__nth")


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """One digest per top folder: hashes of (path, size, content), order-free.

    Each file is hashed where it lies; file digests are folded as 32-bit words
    summed per position, which needs no sorted list of files in one task.
    """
    entries = image_entries(files, root).withColumn("folder", F.coalesce("label", F.lit(".")))
    per_file = F.sha2(F.concat_ws("|", "item_id", "sha256"), 256)
    words = [F.conv(F.substring(per_file, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = entries.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)]
    )
    return sums.select(
        "folder", "files", F.sha2(F.concat_ws(":", "files", *[f"w{i}" for i in range(8)]), 256).alias("digest")
    )
