"""Exact great-circle nearest neighbour without comparing every pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitrank.functions.geo import EARTH_RADIUS_M, haversine_m
from orbitrank.session import cut_lineage

# Distinct reference points are shipped to the tasks only up to this count.
SHIPPED_POINTS = 10_000
_PAIRS_PER_BLOCK = 2_000_000
_COSINE_SLACK = 4e-15

# Larger sides meet through cubes around the unit sphere, halved level by level.
_FIRST_LEVEL = 2
_LAST_LEVEL = 20
_LEAF_POINTS = 32
# Left rows and right points of a list, and pairs of two lists that are measured with others' pairs.
_PART_ROWS, _BLOCK_POINTS, _PAIRS_OF_FEW = 256, 512, 4_096
# Leaf cubes of the left side are shipped to the tasks only up to this count.
SHIPPED_CUBES = 100_000


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Points on the unit sphere, one row each."""
    flat = np.cos(lat)
    return np.column_stack([flat * np.cos(lon), flat * np.sin(lon), np.sin(lat)])


def _block_nearest(lon: np.ndarray, lat: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Metres from each point to the nearest reference point.

    One matrix product finds the reference points that could be nearest; rounding
    makes it blind below ``_COSINE_SLACK``, so every one inside that slack is
    measured by the haversine formula.
    """
    out = np.empty(len(lon))
    step = max(1, _PAIRS_PER_BLOCK // max(1, len(ref)))
    ref_lon, ref_lat = np.radians(ref[:, 0]), np.radians(ref[:, 1])
    lon, lat = np.radians(lon), np.radians(lat)
    left, right = _unit(lon, lat), _unit(ref_lon, ref_lat).T
    for start in range(0, len(lon), step):
        cosines = left[start : start + step] @ right
        row, col = np.nonzero(cosines >= cosines.max(axis=1, keepdims=True) - _COSINE_SLACK)
        at = row + start
        h = np.sin((ref_lat[col] - lat[at]) / 2) ** 2 + (
            np.cos(lat[at]) * np.cos(ref_lat[col]) * np.sin((ref_lon[col] - lon[at]) / 2) ** 2
        )
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        closest = np.minimum.reduceat(h, starts)
        out[start : start + len(closest)] = 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(closest, 0, 1)))
    return out


def _shipped(left: DataFrame, points: DataFrame) -> DataFrame:
    table = points.select("group", "longitude", "latitude").toArrow()
    groups = np.asarray(table.column("group").to_pylist(), dtype=object)
    lonlat = np.column_stack(
        [table.column("longitude").to_numpy(), table.column("latitude").to_numpy()]
    )
    by_group = {g: lonlat[groups == g] for g in set(groups.tolist())}
    shared = left.sparkSession.sparkContext.broadcast(by_group)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("group").to_pylist(), dtype=object)
            lon = batch.column("longitude").to_numpy(zero_copy_only=False)
            lat = batch.column("latitude").to_numpy(zero_copy_only=False)
            out = np.full(len(keys), np.nan)
            for key in set(keys.tolist()):
                if key in shared.value:
                    rows = np.flatnonzero(keys == key)
                    out[rows] = _block_nearest(lon[rows], lat[rows], shared.value[key])
            distance = pa.array(out, pa.float64(), mask=np.isnan(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("left_id"), distance], names=["left_id", "nearest_m"]
            )

    return left.select("left_id", "group", "longitude", "latitude").mapInArrow(
        measure, "left_id string, nearest_m double"
    )


def _on_sphere(points: DataFrame) -> DataFrame:
    """Add the cube of each point at the finest level, as three integers."""
    lon, lat = F.radians("longitude"), F.radians("latitude")
    axes = {
        "ix": F.cos(lat) * F.cos(lon),
        "iy": F.cos(lat) * F.sin(lon),
        "iz": F.sin(lat),
    }
    top = 2**_LAST_LEVEL
    return points.withColumns(
        {
            name: F.least(
                F.lit(top - 1), F.greatest(F.lit(0), F.floor((axis + 1) / 2 * top))
            ).cast("long")
            for name, axis in axes.items()
        }
    )


def _cubes(points: DataFrame, level: int, side: str) -> DataFrame:
    shift = _LAST_LEVEL - level
    return points.groupBy(
        "group", *[F.shiftright(c, shift).alias(f"{side}{c}") for c in ("ix", "iy", "iz")]
    ).agg(F.count(F.lit(1)).alias(f"{side}n"))


def _prune(pairs: DataFrame, level: int, within_chord: float | None) -> DataFrame:
    """Drop cube pairs that cannot hold the nearest point of any left cube.

    Distances between cubes are in cube sides: at least the gap, at most the gap
    plus both cubes.
    """
    gap = far = F.lit(0)
    for axis in ("ix", "iy", "iz"):
        apart = F.abs(F.col(f"l{axis}") - F.col(f"r{axis}"))
        gap = gap + F.pow(F.greatest(apart - 1, F.lit(0)), 2)
        far = far + F.pow(apart + 1, 2)
    left = Window.partitionBy("group", "lix", "liy", "liz")
    kept = (
        pairs.withColumns({"__gap": gap, "__far": far})
        .withColumn("__best", F.min("__far").over(left))
        .filter(F.col("__gap") <= F.col("__best"))
    )
    if within_chord is not None:
        side = 2.0 / 2**level
        kept = kept.filter(F.sqrt("__gap") * side <= within_chord * (1 + 1e-9) + 1e-12)
    return kept.select("group", "lix", "liy", "liz", "rix", "riy", "riz")


def _leaf_level(right: DataFrame, n_right: int) -> int:
    """First level at which no reference cube is crowded."""
    level = min(_LAST_LEVEL, max(_FIRST_LEVEL, math.ceil(math.log(max(n_right, 1), 4))))
    while level < _LAST_LEVEL:
        crowd = _cubes(right, level, "r").agg(F.max("rn")).first()[0]
        if crowd is None or crowd <= _LEAF_POINTS:
            break
        level = min(_LAST_LEVEL, level + 2)
    return level


def _coarser(cubes: DataFrame, halvings: int, side: str) -> DataFrame:
    """The cubes that hold the given ones, so many levels up."""
    axes = [f"{side}{c}" for c in ("ix", "iy", "iz")]
    return cubes.select("group", *[F.shiftright(c, halvings).alias(c) for c in axes]).distinct()


def _descend(
    left: DataFrame, right: DataFrame, n_right: int, within_chord: float | None
) -> DataFrame:
    """left_id, nearest_m of every left row; NULL without a group, coordinates or a neighbour.

    Points are dealt to their leaf cubes once; every coarser level comes from those.
    """
    right = cut_lineage(_on_sphere(right.where(_located())))
    leaf = _leaf_level(right, n_right)
    left = _on_sphere(left)
    l_cubes = cut_lineage(_cubes(left.where(_located()), leaf, "l"))
    r_cubes = cut_lineage(_cubes(right, leaf, "r"))
    level = _FIRST_LEVEL
    # Sixty-four coarse cubes cover the sphere: each left cube names them all and
    # keeps those that hold reference points, an equi-join of a bounded table.
    across = F.sequence(F.lit(0).cast("long"), F.lit(2**level - 1).cast("long"))
    named = _coarser(l_cubes, leaf - level, "l")
    for axis in ("rix", "riy", "riz"):
        named = named.withColumn(axis, F.explode(across))
    pairs = _prune(
        named.join(_coarser(r_cubes, leaf - level, "r"), ["group", "rix", "riy", "riz"]), level, within_chord
    )
    while level < leaf:
        level += 1
        for side, cubes in (("l", l_cubes), ("r", r_cubes)):
            axes = [f"{side}{c}" for c in ("ix", "iy", "iz")]
            children = _coarser(cubes, leaf - level, side).select(
                "group",
                *axes,
                *[F.shiftright(c, 1).alias(f"__{c}") for c in axes],
            )
            parents = pairs.withColumnsRenamed({c: f"__{c}" for c in axes})
            pairs = parents.join(children, ["group", *[f"__{c}" for c in axes]]).drop(
                *[f"__{c}" for c in axes]
            )
        pairs = _prune(pairs, level, within_chord)
        if level % 3 == 0:
            pairs = cut_lineage(pairs)
    shift = _LAST_LEVEL - leaf
    return _in_leaves(_in_parts(left, l_cubes, shift), _candidates(right, r_cubes, pairs, shift))


def _located() -> Column:
    """Rows that can have, or be, a neighbour at all."""
    placed = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("longitude", "latitude")]
    return F.col("group").isNotNull() & placed[0] & placed[1]


def _in_parts(left: DataFrame, l_cubes: DataFrame, shift: int) -> DataFrame:
    """Left rows as lists of about ``_PART_ROWS``, each of one leaf cube."""
    names = ["group", "lix", "liy", "liz"]
    parts = l_cubes.select(*names, F.ceil(F.col("ln") / _PART_ROWS).alias("parts"))
    if l_cubes.count() <= SHIPPED_CUBES:
        parts = F.broadcast(parts)
    cube = [F.when(_located(), F.shiftright(c, shift)).alias(f"l{c}") for c in ("ix", "iy", "iz")]
    rows = left.select("left_id", "longitude", "latitude", "group", *cube).join(parts, names, "left")
    # Rows that lie nowhere are dealt out too.
    part = F.pmod(F.xxhash64("left_id", "longitude", "latitude"), F.coalesce("parts", F.lit(4_096)))
    lists = rows.groupBy(*names, part.alias("part")).agg(
        F.collect_list(F.struct("left_id", "longitude", "latitude")).alias("rows")
    )
    # Written, so that a list has one order however often it is met.
    return cut_lineage(lists.select(
        *names, "part", F.col("rows.left_id").alias("ids"), F.col("rows.longitude").alias("lon"),
        F.col("rows.latitude").alias("lat"),
    ))


def _candidates(right: DataFrame, r_cubes: DataFrame, pairs: DataFrame, shift: int) -> DataFrame:
    """The right points that each left leaf cube has to meet, in lists of about ``_BLOCK_POINTS``."""
    names, axes = ["group", "lix", "liy", "liz"], ("ix", "iy", "iz")
    cube = ["group", *[f"r{c}" for c in axes]]
    points = right.groupBy("group", *[F.shiftright(c, shift).alias(f"r{c}") for c in axes]).agg(
        F.collect_list(F.struct("longitude", "latitude")).alias("points")
    )
    before = Window.partitionBy(*names).orderBy(*cube[1:]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = pairs.join(r_cubes, cube).withColumn(
        "block", F.floor(F.coalesce(F.sum("rn").over(before), F.lit(0)) / _BLOCK_POINTS)
    )
    blocks = numbered.join(points, cube).groupBy(*names, "block").agg(
        F.flatten(F.collect_list("points")).alias("points")
    )
    return blocks.select(*names, F.col("points.longitude").alias("lons"), F.col("points.latitude").alias("lats"))


def _in_leaves(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """The last step of the descent: each list of left rows against the lists of its cube's candidates.

    Both lists are bounded. A left row crosses shuffles inside its list, and its list is
    repeated only where a cube's candidates fill several lists.
    """
    names = ["group", "lix", "liy", "liz"]
    key = "group string, lix bigint, liy bigint, liz bigint, part bigint, ids array<string>"
    met = parts.join(blocks, names, "left").select(*names, "part", "ids", "lon", "lat", "lons", "lats")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = pc.list_value_length(batch.column(6)).to_numpy(zero_copy_only=False)
            metres = np.concatenate([np.zeros(0), *_lists_nearest(*[batch.column(i) for i in range(6, 10)])])
            offsets = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(metres, pa.float64(), mask=np.isnan(metres)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], lists], names=[*names, "part", "ids", "metres"])

    measured = met.mapInArrow(measure, f"{key}, metres array<double>").groupBy(*names, "part").agg(
        F.first("ids").alias("ids"), F.collect_list("metres").alias("all")
    )
    least = F.aggregate(
        F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)),
        lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y)),
    )
    return measured.select(F.explode(F.arrays_zip("ids", least.alias("metres"))).alias("row")).select(
        F.col("row.ids").alias("left_id"), F.col("row.metres").alias("nearest_m")
    )


def _lists_nearest(lon: pa.Array, lat: pa.Array, lons: pa.Array, lats: pa.Array) -> Iterator[np.ndarray]:
    """Metres from each point of each row's first lists to the nearest of its second ones (NaN without any).

    Rows of many pairs are measured one at a time, rows of few together.
    """
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (lon, lons)]
    flat = [pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (lon, lat, lons, lats)]
    begins = [np.append(0, np.cumsum(n)) for n in sizes]
    pairs, row = sizes[0] * sizes[1], 0
    few = np.append(0, np.cumsum(np.where(pairs > _PAIRS_OF_FEW, _PAIRS_PER_BLOCK, pairs)))
    while row < len(pairs):
        here = slice(begins[0][row], begins[0][row + 1])
        if pairs[row] > _PAIRS_OF_FEW:
            there = slice(begins[1][row], begins[1][row + 1])
            yield _block_nearest(flat[0][here], flat[1][here], np.column_stack([x[there] for x in flat[2:]]))
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(few, few[row] + _PAIRS_PER_BLOCK)) - 1)
        # The pairs of each left point lie together: its row's right points, one after another.
        n, other = sizes[0][row:last], sizes[1][row:last]
        each = np.repeat(other, n)
        at = np.repeat(np.arange(begins[0][row], begins[0][last]), each)
        begun = np.cumsum(each) - each
        to = np.arange(len(at)) - np.repeat(begun - np.repeat(begins[1][row:last], n), each)
        a, b, c, d = (np.radians(flat[i][j]) for i, j in ((0, at), (1, at), (2, to), (3, to)))
        h = np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2
        out = np.full(len(each), np.nan)
        if len(at):
            out[each > 0] = np.minimum.reduceat(h, begun[each > 0])
        yield 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(out, 0, 1)))
        row = last


def nearest_distance(
    left: DataFrame, right: DataFrame, group: str | None = None,
    within_m: float | None = None, shipped_points: int = SHIPPED_POINTS,
) -> DataFrame:
    """Metres from every left row to its nearest right row of the same ``group``.

    ``left`` has (left_id, longitude, latitude), ``right`` (longitude, latitude).
    Rows without any neighbour (or none within ``within_m``) get NULL. Copies of a
    coordinate are one point. The distinct right points are counted: few are
    shipped to the tasks, many are met by descending through cubes.
    """
    key = F.lit(0).cast("string") if group is None else F.col(group).cast("string")
    lefts = left.select("left_id", "longitude", "latitude", key.alias("group"))
    points = right.select("longitude", "latitude", key.alias("group")).distinct()
    points = points.filter(F.col("group").isNotNull())
    n_points = points.count()
    if n_points == 0:
        return lefts.select("left_id", F.lit(None).cast("double").alias("nearest_m"))
    if n_points <= shipped_points:
        found = _shipped(lefts, points)
        if within_m is not None:
            near = F.when(F.col("nearest_m") <= within_m, F.col("nearest_m"))
            found = found.withColumn("nearest_m", near)
        return found
    chord = None if within_m is None else 2 * math.sin(min(within_m / EARTH_RADIUS_M, math.pi) / 2)
    found = _descend(lefts, points, n_points, chord)
    if within_m is not None:
        found = found.withColumn("nearest_m", F.when(F.col("nearest_m") <= within_m, F.col("nearest_m")))
    return found


def guard_band(
    left: DataFrame, right: DataFrame, minimum_m: float, shipped_points: int = SHIPPED_POINTS
) -> DataFrame:
    """Left rows at least ``minimum_m`` from every right row (the boundary is kept)."""
    near = nearest_distance(left, right, within_m=minimum_m, shipped_points=shipped_points)
    too_close = near.filter(F.col("nearest_m") < minimum_m).select("left_id")
    return left.join(too_close, "left_id", "left_anti")
