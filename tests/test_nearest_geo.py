import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrank.functions import geo
from orbitrank.operators import nearest


def haversine(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = map(np.radians, (lon1, lat1, lon2, lat2))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def frame(spark, points, name):
    return spark.createDataFrame(
        [(f"{name}{i}", float(x), float(y), g) for i, (x, y, g) in enumerate(points)],
        "left_id string, longitude double, latitude double, label string",
    )


def world(rng, n, hot=0):
    lon, lat = rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    points = [(x, y, "a" if i % 3 else "b") for i, (x, y) in enumerate(zip(lon, lat))]
    points += [(10 + rng.uniform(0, 0.01), 50 + rng.uniform(0, 0.01), "a") for _ in range(hot)]
    return points + [(179.99, 0.0, "a"), (-179.99, 1.0, "b"), (30.0, 90.0, "a"), (-60.0, -90.0, "b"), (5.0, 5.0, None)]


@pytest.mark.parametrize("shipped", [10**6, 0])
def test_both_ways_equal_brute_force(spark, shipped):
    rng = np.random.default_rng(7)
    left, right = world(rng, 150, hot=60), world(rng, 120, hot=80)
    got = {r[0]: r[1] for r in nearest.nearest_distance(frame(spark, left, "l"), frame(spark, right, "r"), shipped_points=shipped).collect()}
    ref = np.array([(x, y) for x, y, _ in right])
    for i, (x, y, _) in enumerate(left):
        assert got[f"l{i}"] == pytest.approx(haversine(x, y, ref[:, 0], ref[:, 1]).min(), abs=1e-6)


@pytest.mark.parametrize("shipped", [10**6, 0])
def test_groups_and_missing_neighbours(spark, shipped):
    rng = np.random.default_rng(8)
    left, right = world(rng, 60), [p for p in world(rng, 60) if p[2] != "b"]
    found = nearest.nearest_distance(frame(spark, left, "l"), frame(spark, right, "r"), group="label", shipped_points=shipped)
    got = {r[0]: r[1] for r in found.collect()}
    ref = np.array([(x, y) for x, y, g in right if g == "a"])
    for i, (x, y, g) in enumerate(left):
        if g == "a":
            assert got[f"l{i}"] == pytest.approx(haversine(x, y, ref[:, 0], ref[:, 1]).min(), abs=1e-6)
        else:
            assert got[f"l{i}"] is None
    empty = frame(spark, right, "r").limit(0)
    assert {r[1] for r in nearest.nearest_distance(frame(spark, left, "l"), empty).collect()} == {None}


@pytest.mark.parametrize("shipped", [10**6, 0])
def test_guard_keeps_the_boundary(spark, shipped, monkeypatch):
    monkeypatch.setattr(nearest.nearest_distance, "__defaults__", (None, None, shipped))
    step = math.degrees(1000 / geo.EARTH_RADIUS_M)
    left = frame(spark, [(0.0, 0.0, "a"), (0.0, step, "a"), (0.0, 2 * step, "a")], "l")
    right = frame(spark, [(0.0, 0.0, "a")], "r")
    exact = nearest.nearest_distance(left, right).filter("left_id = 'l1'").first()[1]
    kept = {r["left_id"] for r in nearest.guard_band(left, right, exact).collect()}
    assert kept == {"l1", "l2"}


def test_no_cartesian_plan(spark):
    rng = np.random.default_rng(9)
    found = nearest.nearest_distance(frame(spark, world(rng, 50), "l"), frame(spark, world(rng, 50), "r"), shipped_points=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_a_descent_deals_each_side_to_its_cubes_once(spark, monkeypatch):
    """Every coarser level comes from the leaf cubes: no level reads the points again."""
    dealt, cubes = [], nearest._cubes
    monkeypatch.setattr(nearest, "_cubes", lambda points, level, side: dealt.append(side) or cubes(points, level, side))
    rng = np.random.default_rng(10)
    nearest.nearest_distance(frame(spark, world(rng, 300), "l"), frame(spark, world(rng, 300), "r"), shipped_points=0).collect()
    assert dealt.count("l") == 1


def test_the_tier_summary_by_descent_deals_its_candidates_once(spark, sf_dir, monkeypatch):
    from oracle_compare import compare, connect

    from __spark_entry__ import oracle_sql, queries

    dealt, cubes = [], nearest._cubes
    monkeypatch.setattr(nearest, "_cubes", lambda points, level, side: dealt.append(side) or cubes(points, level, side))
    monkeypatch.setattr(nearest.nearest_distance, "__defaults__", (None, None, 0))
    found = queries()["distance_tier_summary"](spark, sf_dir)
    assert dealt.count("l") == 1
    assert compare(found, oracle_sql()["distance_tier_summary"], connect(sf_dir)) is None


def test_a_descent_by_short_lists_keeps_every_left_row(spark, monkeypatch):
    """Hot cubes fill several lists on both sides; rows that lie nowhere have no distance, copies have one each."""
    monkeypatch.setattr(nearest, "_PART_ROWS", 5)
    monkeypatch.setattr(nearest, "_BLOCK_POINTS", 7)
    monkeypatch.setattr(nearest, "_PAIRS_OF_FEW", 20)
    rng = np.random.default_rng(11)
    left, right = world(rng, 40, hot=120), world(rng, 30, hot=90)
    left += [left[0]] * 20 + [(math.nan, 1.0, "a")]
    nowhere = spark.createDataFrame([("none", None, 1.0, "a")], "left_id string, longitude double, latitude double, label string")
    found = nearest.nearest_distance(frame(spark, left, "l").unionByName(nowhere), frame(spark, right, "r"), shipped_points=0).collect()
    got, ref = {r[0]: r[1] for r in found}, np.array([(x, y) for x, y, _ in right])
    assert len(found) == len(got) == len(left) + 1
    assert got.pop("none") is None and got.pop(f"l{len(left) - 1}") is None
    for i, (x, y, _) in enumerate(left[:-1]):
        assert got[f"l{i}"] == pytest.approx(haversine(x, y, ref[:, 0], ref[:, 1]).min(), abs=1e-6)


def utm_forward(lon, lat, zone):
    """Snyder's published series, independent of the inverse under test."""
    a, f, k0 = geo.WGS84_A, geo.WGS84_F, geo.UTM_SCALE
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, A = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, math.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi)
        - (35 * e2**3 / 3072) * math.sin(6 * phi)
    )
    x = k0 * n * (A + (1 - t + c) * A**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * A**5 / 120)
    y = k0 * (m + n * math.tan(phi) * (A**2 / 2 + (5 - t + 9 * c + 4 * c**2) * A**4 / 24
              + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * A**6 / 720))
    return x + 500_000, y + (10_000_000 if lat < 0 else 0)


def test_utm_inverse_against_forward_series(spark):
    wanted = [(33, 15.5, 48.2), (33, 13.1, 52.9), (1, -177.2, 5.0), (60, 176.0, 63.0), (34, 20.0, -33.5)]
    rows = []
    for zone, lon, lat in wanted:
        x, y = utm_forward(lon, lat, zone)
        rows.append(((32600 if lat >= 0 else 32700) + zone, x, y, lon, lat))
    df = spark.createDataFrame(rows, "epsg int, x double, y double, lon double, lat double")
    for row in geo.add_lonlat(df, F.col("epsg"), F.col("x"), F.col("y"), "a", "b").collect():
        assert haversine(row["a"], row["b"], row["lon"], row["lat"]) < 0.01


def test_equal_area_projection_covers_equal_areas(spark):
    """The world's projected area must equal the ellipsoid's surface."""
    # Published extent of the global grid on this projection.
    corner = spark.range(1).select(*geo.equal_area_xy(F.lit(180.0), F.lit(85.0445664))).first()
    assert tuple(corner) == pytest.approx((17367530.445, 7314540.831), abs=0.01)
    x, y = spark.range(1).select(*geo.equal_area_xy(F.lit(180.0), F.lit(90.0))).first()
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    e = math.sqrt(e2)
    surface = 2 * math.pi * geo.WGS84_A**2 * (1 + (1 - e2) / e * math.atanh(e))
    assert 4 * x * y == pytest.approx(surface, rel=1e-9)


def test_bands_floor_below_zero(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (47.3,), (-90.0,)], "lat double")
    got = [r[0] for r in df.select(geo.latitude_band(F.col("lat"), 5.0)).collect()]
    assert got == ["-005.00..+000.00", "+000.00..+005.00", "+045.00..+050.00", "-090.00..-085.00"]


def test_mgrs_and_defects(spark):
    tiles = spark.createDataFrame([("33UUP",), ("33MUP",), ("01NAA",)], "t string")
    assert [r[0] for r in tiles.select(geo.mgrs_epsg(F.col("t"))).collect()] == [32633, 32733, 32601]
    points = spark.createDataFrame(
        [(0.0, 0.0), (181.0, 0.0), (0.0, -91.0), (float("nan"), 0.0), (0.0, float("inf")), (None, 1.0)], "x double, y double")
    assert [r[0] for r in points.select(geo.coordinate_defect(F.col("x"), F.col("y"))).collect()] == [
        None, "out_of_bounds", "out_of_bounds", "non_finite", "non_finite", "non_finite"]
