"""Expectations: rules over a DataFrame that return the rows breaking them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitrank.functions import geo
from orbitrank.functions.hashing import content_sha256, is_sha256
from orbitrank.functions.vectors import vector_defect
from orbitrank.operators.frames import stack


@dataclass(frozen=True)
class Rule:
    """A named condition that is true for a row breaking it."""

    name: str
    broken: Column
    detail: Column | None = None


def violations(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(rule, key) rows for every rule a row breaks, in one pass over the data."""
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules])
    )
    return df.select(F.explode(found).alias("rule"), F.col(key).cast("string").alias("key"))


def enforce(found: DataFrame) -> None:
    """Raise on the first violation; reads one row only."""
    first = found.limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['rule']}: {first[0]['key']}")


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    return (
        df.groupBy(key).count().filter("count > 1")
        .select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    )


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Record rules, unique ids, and one split and one label per content hash.

    The per-hash rules compare min and max, so copies combine before the shuffle.
    """
    rows = violations(
        manifest, "item_id",
        [
            Rule("empty_item_id", F.coalesce("item_id", F.lit("")) == ""),
            Rule("empty_path", F.coalesce("path", F.lit("")) == ""),
            Rule("unknown_split", ~F.coalesce(F.col("split").isin("index", "query"), F.lit(False))),
        ],
    )
    per_hash = manifest.filter(F.col("sha256").isNotNull()).groupBy("sha256").agg(
        F.min("split").alias("s1"), F.max("split").alias("s2"),
        F.min("label").alias("l1"), F.max("label").alias("l2"),
        F.count_if(F.col("label").isNull()).alias("unlabeled"),
    )
    hashes = violations(
        per_hash, "sha256",
        [
            Rule("content_in_two_splits", F.col("s1") != F.col("s2")),
            Rule("content_has_two_labels", (F.col("l1") != F.col("l2"))
                 | ((F.col("unlabeled") > 0) & F.col("l1").isNotNull())),
        ],
    )
    return stack(rows, duplicates(manifest, "item_id", "duplicate_item_id"), hashes)


def vector_violations(store: DataFrame) -> DataFrame:
    """Vectors of either split that cannot be normalised."""
    return store.select(
        vector_defect(F.col("embedding")).alias("rule"), F.col("item_id").alias("key")
    ).filter("rule IS NOT NULL")


def coordinate_violations(points: DataFrame, key: str) -> DataFrame:
    return points.select(
        geo.coordinate_defect(F.col("longitude"), F.col("latitude")).alias("rule"),
        F.col(key).cast("string").alias("key"),
    ).filter("rule IS NOT NULL")


def bbox_violations(boxes: DataFrame, key: str) -> DataFrame:
    return boxes.select(
        geo.bbox_defect(*[F.col(c) for c in ("west", "south", "east", "north")]).alias("rule"),
        F.col(key).cast("string").alias("key"),
    ).filter("rule IS NOT NULL")


def url_violations(urls: DataFrame, key: str, url: str = "url") -> DataFrame:
    """Endpoints must be https with a host and carry no userinfo, query or fragment."""
    def part(name: str) -> Column:
        return F.try_parse_url(F.col(url), F.lit(name))

    def present(c: Column) -> Column:
        return F.coalesce(F.length(c) > 0, F.lit(False))

    return violations(
        urls, key,
        [
            Rule("not_https", ~F.lower(part("PROTOCOL")).eqNullSafe(F.lit("https"))),
            Rule("no_host", ~present(part("HOST"))),
            Rule("has_userinfo", part("USERINFO").isNotNull()),
            Rule("has_query", present(part("QUERY"))),
            Rule("has_fragment", present(part("REF"))),
        ],
    )


def path_violations(paths: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Image paths must stay relative: no drive, no root, no parent segment."""
    p = F.col(path)
    return violations(
        paths, key,
        [
            Rule("has_drive", p.rlike(r"^[A-Za-z]:")),
            Rule("has_root", p.rlike(r"^([A-Za-z]:)?[\\/]")),
            Rule("has_parent_segment", p.rlike(r"(^|[\\/])\.\.([\\/]|$)")),
        ],
    )


def hash_format_violations(reports: DataFrame, key: str, document: str) -> DataFrame:
    """Every ``*_sha256`` value anywhere in a JSON document must be 64 hex digits."""
    pairs = F.regexp_extract_all(
        F.col(document), F.lit(r'"([A-Za-z0-9_]*sha256)"\s*:\s*("[^"]*"|[^,}\]\s]+)'), F.lit(0)
    )
    fields = reports.select(F.col(key).cast("string").alias("key"), F.explode(pairs).alias("pair"))
    value = F.regexp_extract("pair", r':\s*"?([^"]*)"?$', 1)
    return fields.select(
        F.lit("malformed_sha256").alias("rule"), "key", value.alias("value")
    ).filter(~is_sha256(F.col("value")))


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose file is missing or has other content.

    ``files`` has (path, content), as the binary file source reads it.
    """
    digests = files.select("path", content_sha256(F.col("content")).alias("__observed"))
    joined = manifest.select("item_id", "path", "sha256").join(digests, "path", "left")
    rule = F.when(F.col("__observed").isNull(), "missing_file").when(
        F.col("sha256").isNotNull() & (F.col("__observed") != F.col("sha256")), "checksum_mismatch"
    )
    return joined.select(rule.alias("rule"), F.col("item_id").alias("key")).filter("rule IS NOT NULL")


def catalog_violations(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Store rows the manifest lacks, or whose label or split it contradicts."""
    known = manifest.select(
        "item_id", F.col("label").alias("__label"), F.col("split").alias("__split"),
        F.lit(True).alias("__in"),
    )
    joined = store.select("item_id", "label", "split").join(known, "item_id", "left")
    return violations(
        joined, "item_id",
        [
            Rule("missing_from_manifest", F.col("__in").isNull()),
            Rule("label_disagrees", F.col("__in") & ~F.col("label").eqNullSafe(F.col("__label"))),
            Rule("split_disagrees", F.col("__in") & ~F.col("split").eqNullSafe(F.col("__split"))),
        ],
    )


def same_corpus_violations(stores: DataFrame, meta: DataFrame, n_stores: int) -> DataFrame:
    """Positions at which stores differ, and manifest hashes that are absent or differ.

    ``stores`` stacks (store, position, item_id, split, label). Equality is min = max
    of a struct per position, so no store is joined to another.
    """
    row = F.struct("item_id", "split", "label")
    per_position = stores.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), F.min(row).alias("a"), F.max(row).alias("b")
    )
    rows = violations(
        per_position, "position",
        [
            Rule("position_missing_in_a_store", F.col("n") != n_stores),
            Rule("rows_differ", F.col("a") != F.col("b")),
        ],
    )
    hashes = violations(meta, "store", [Rule("no_manifest_hash", F.col("manifest_sha256").isNull())])
    digests = meta.agg(F.min("manifest_sha256").alias("a"), F.max("manifest_sha256").alias("b"))
    differ = digests.filter("a <> b").select(
        F.lit("manifest_hashes_differ").alias("rule"), F.lit("all").alias("key")
    )
    return stack(rows, hashes, differ)


def projection_violations(projection: DataFrame, meta: DataFrame) -> DataFrame:
    """Why a saved projection cannot be used with a store: hash, image size, dimension.

    Both are one-row-per-store tables; hashes are compared only when both exist.
    """
    joined = projection.alias("p").join(meta.alias("m"), F.col("p.store") == F.col("m.store"))
    return violations(
        joined.select(
            F.col("m.store").alias("store"),
            (F.col("p.manifest_sha256") != F.col("m.manifest_sha256")).alias("hash"),
            (F.col("p.image_size") != F.col("m.image_size")).alias("size"),
            (F.col("p.dimension") != F.col("m.dimension")).alias("dim"),
        ),
        "store",
        [
            Rule("manifest_hash_differs", F.col("hash")),
            Rule("image_size_differs", F.col("size")),
            Rule("dimension_differs", F.col("dim")),
        ],
    )


def band_geometry_violations(observed: DataFrame, footprints: DataFrame) -> DataFrame:
    """Raster headers against what each band's resolution implies for a 1200 m patch.

    ``observed`` has (patch_id, band, gsd, bounds, transform, epsg, height, width, dtype).
    """
    # Footprints are one to a patch: they are hashed, so the headers, one to a band, need no sort.
    joined = observed.join(
        footprints.select("patch_id", "left", "bottom", "right", "top", F.col("epsg").alias("__epsg")).hint("shuffle_hash"),
        "patch_id", "left",
    )
    shape = (F.lit(1200) / F.col("gsd")).cast("int")
    bounds = F.array("left", "bottom", "right", "top")
    gsd = F.col("gsd").cast("double")
    transform = F.array(gsd, F.lit(0.0), F.col("left"), F.lit(0.0), -gsd, F.col("top"))
    keyed = joined.withColumn("__key", F.concat_ws("/", "patch_id", "band"))
    return violations(
        keyed, "__key",
        [
            Rule("no_footprint", F.col("__epsg").isNull()),
            Rule("bounds_differ", F.col("bounds") != bounds),
            Rule("transform_differs", F.col("transform") != transform),
            Rule("epsg_differs", ~F.col("epsg").eqNullSafe(F.col("__epsg")) & F.col("__epsg").isNotNull()),
            Rule("shape_differs", (F.col("height") != shape) | (F.col("width") != shape)),
            Rule("dtype_differs", F.col("dtype") != "uint16"),
        ],
    )


def completeness_violations(
    selected: DataFrame, received: DataFrame, bands: Sequence[str]
) -> DataFrame:
    """Selected patches without every band in order, foreign patches, digest mismatches.

    ``received`` has (patch_id, band, file_sha256, observed_sha256).
    """
    order = {band: i for i, band in enumerate(bands)}
    position = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    per_patch = received.groupBy("patch_id").agg(
        F.array_join(F.array_sort(F.collect_set(position[F.col("band")])), ",").alias("have"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("file_sha256").eqNullSafe(F.col("observed_sha256"))).alias("bad"),
    )
    expected = ",".join(str(i) for i in range(len(bands)))
    joined = selected.select("patch_id", F.lit(True).alias("__wanted")).distinct().join(
        per_patch, "patch_id", "full_outer"
    )
    return violations(
        joined, "patch_id",
        [
            Rule("not_received", F.col("n").isNull()),
            Rule("foreign_patch", F.col("__wanted").isNull()),
            Rule("bands_incomplete", (F.col("have") != expected) | (F.col("n") != len(bands))),
            Rule("digest_mismatch", F.col("bad") > 0),
        ],
    )
