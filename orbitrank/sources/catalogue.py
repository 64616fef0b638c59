"""Catalogue-item tables: read, search, allow-list, guarded write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitrank.operators.checks import Rule, enforce, violations

ITEM_SCHEMA = T.StructType([
    T.StructField("api_url", T.StringType()),
    T.StructField("collection", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("datetime", T.TimestampType()),
    T.StructField("asset_keys", T.ArrayType(T.StringType())),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])

# Item properties that carry no address, credential or
# infrastructure detail.
SAFE_PROPERTIES = (
    "constellation", "eo:cloud_cover", "eo:snow_cover", "grid:code", "gsd", "instruments",
    "platform", "processing:level", "processing:version", "product:type", "proj:epsg",
    "s2:mgrs_tile", "s2:processing_baseline", "sat:orbit_state", "sat:relative_orbit",
    "view:incidence_angle", "view:sun_azimuth", "view:sun_elevation",
)


@dataclass(frozen=True)
class Search:
    """Bounds, closed date range and ceilings of one catalogue search.

    Without ``limit`` a search returns all that it finds.
    """

    collection: str
    west: float
    south: float
    east: float
    north: float
    start: str
    end: str
    limit: int | None = None
    max_cloud_cover: float | None = None

    def defects(self) -> list[str]:
        """What is wrong with the request, each as one phrase."""
        longitudes, latitudes = (self.west, self.east), (self.south, self.north)
        rules = {
            "west to east is no range of longitudes": _ascending(longitudes, 180),
            "south to north is no range of latitudes": _ascending(latitudes, 90),
            "collection, first and last date are needed": all((self.collection, self.start, self.end)),
            "a limit is at least one": self.limit is None or self.limit >= 1,
            "a cloud ceiling is a share of a hundred": self.max_cloud_cover is None
            or 0 <= self.max_cloud_cover <= 100,
        }
        return [phrase for phrase, holds in rules.items() if not holds]

    def __post_init__(self) -> None:
        if found := self.defects():
            raise ValueError("; ".join(found))


def _ascending(pair: tuple[float, float], most: float) -> bool:
    return -most <= pair[0] < pair[1] <= most


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed items, and lines that are not readable items."""
    schema = T.StructType([*ITEM_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).json(path)
    bad = F.col("_corrupt_record").isNotNull() | F.col("item_id").isNull()
    broken = rows.filter(bad).select(
        F.lit("unreadable_item").alias("rule"), F.coalesce("_corrupt_record", F.lit("?")).alias("key")
    )
    four = F.when(F.size("bbox") == 4, F.col("bbox"))
    return rows.filter(~bad).drop("_corrupt_record").withColumn("bbox", four), broken


def search(items: DataFrame, query: Search) -> DataFrame:
    """Items meeting bounds, dates and cloud; with a limit the first by (datetime, id).

    A missing cloud share never passes a cloud ceiling. An end that is a day takes in the
    whole day. Every condition is a plain column comparison, so those on flat columns reach
    the scan.
    """
    end = F.lit(query.end).cast("timestamp")
    in_time = F.col("datetime") >= F.lit(query.start).cast("timestamp")
    if len(query.end) == len("2000-01-01"):
        in_time &= F.col("datetime") < end + F.expr("INTERVAL 1 DAY")
    else:
        in_time &= F.col("datetime") <= end
    west, south, east, north = (F.col("bbox")[i] for i in range(4))
    found = items.filter(
        (F.col("collection") == query.collection)
        & in_time
        & (west <= query.east) & (east >= query.west)
        & (south <= query.north) & (north >= query.south)
    )
    if query.max_cloud_cover is not None:
        cloud = F.col("properties")["eo:cloud_cover"].try_cast("double")
        found = found.filter(cloud < query.max_cloud_cover)
    kept = allow_listed(found)
    return kept if query.limit is None else kept.orderBy("datetime", "item_id").limit(query.limit)


def allow_listed(items: DataFrame, keys: Sequence[str] = SAFE_PROPERTIES) -> DataFrame:
    """Keep only safe property keys and sorted asset names."""
    allowed = F.array(*[F.lit(k) for k in keys])
    return items.withColumns({
        "properties": F.map_filter("properties", lambda k, _: F.array_contains(allowed, k)),
        "asset_keys": F.array_sort("asset_keys"),
    })


def preview(items: DataFrame, offset: int, n: int) -> DataFrame:
    """A window of rows in (datetime, id) order, as a preview shows them."""
    return items.orderBy("datetime", "item_id").offset(offset).limit(n)


def leak_violations(items: DataFrame, words: Sequence[str] = ("href",)) -> DataFrame:
    """Rows whose serialised text mentions an asset address (or another banned word)."""
    text = F.lower(F.to_json(F.struct(*[F.col(c) for c in items.columns])))
    return violations(
        items, "item_id", [Rule(f"contains_{w}", F.contains(text, F.lit(w))) for w in words]
    )


def write_items(items: DataFrame, path: str, words: Sequence[str] = ("href",)) -> None:
    """Write sanitised items as JSON lines, refusing any row that leaks an address."""
    enforce(leak_violations(items, words))
    items.select(*sorted(items.columns)).write.mode("overwrite").json(path)
