"""Lines of text files with their numbers, however the files are split between tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and line (from 1) of every line of the text files at ``path``.

    A task reads a block of a file from its first to its last line. Counting the lines of
    each block gives the number at which it begins, so no file is read in one task: what
    meets in a window is one row for each block of a file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return lines.join(begun, ["file", "start"]).select(
        "value", "file", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line")
    )
