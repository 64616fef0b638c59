"""Digests of file trees as Merkle trees over ranges of hashed paths.

Files are ordered by the hash of their path. A leaf is the range of those that begin with
the same ``digits`` hex digits; a node above is the range of one digit less, up to the
root. A leaf's digest is over path, size and content hash of its files in order, a node's
over its children's. So no task holds more than a leaf, the root says what arrived, and
two trees are compared range by range without listing what is equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitrank.functions.hashing import content_sha256
from orbitrank.session import cut_lineage

#: Hex digits of a leaf: 4,096 leaves. More for trees of over a hundred million files.
DIGITS = 3


def tree_entries(files: DataFrame, root: str, skip_directories: Sequence[str] = ()) -> DataFrame:
    """path below ``root``, size and sha256 of each file of ``files`` (path, content).

    Files below a folder named in ``skip_directories``, or called so, are left out.
    """
    stem = root.rstrip("/") + "/"
    inside = F.expr(f"substring(path, instr(path, '{stem}') + {len(stem)})")
    skipped = F.array(*map(F.lit, skip_directories)).cast("array<string>")
    kept = files.where(~F.arrays_overlap(F.split(inside, "/"), skipped)) if skip_directories else files
    return kept.select(
        inside.alias("path"), F.octet_length("content").cast("bigint").alias("size"),
        content_sha256(F.col("content")).alias("sha256"),
    )


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256)


def merkle_nodes(entries: DataFrame, digits: int = DIGITS) -> DataFrame:
    """level (0 is the root), prefix, files, bytes and digest of every node of the tree."""
    hashed = F.sha2("path", 256)
    line = F.concat_ws("|", hashed, "path", F.col("size").cast("string"), "sha256")
    level = entries.groupBy(F.substring(hashed, 1, digits).alias("prefix")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), _digest(line).alias("digest")
    )
    nodes = None
    for depth in range(digits, -1, -1):
        level = cut_lineage(level)
        numbered = level.select(F.lit(depth).alias("level"), "*")
        nodes = numbered if nodes is None else nodes.unionByName(numbered)
        level = level.groupBy(F.substring("prefix", 1, depth - 1).alias("prefix")).agg(
            F.sum("files").alias("files"), F.sum("bytes").alias("bytes"),
            _digest(F.concat_ws("|", "prefix", "digest")).alias("digest"),
        ) if depth else level
    return nodes


def merkle_digest(entries: DataFrame, digits: int = DIGITS) -> DataFrame:
    """files, bytes and digest of the whole tree; no row for a tree without files."""
    return merkle_nodes(entries, digits).where("level = 0").select("files", "bytes", "digest")


def merkle_differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """prefix of every leaf whose digest differs between two trees' ``merkle_nodes``."""
    depth = F.lit(one.agg(F.max("level")).first()[0])
    left, right = (x.where(F.col("level") == depth).select("prefix", F.col("digest").alias(name))
                   for x, name in ((one, "left"), (two, "right")))
    return left.join(right, "prefix", "full").where(~F.col("left").eqNullSafe(F.col("right"))).select("prefix")
