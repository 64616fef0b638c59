"""Geodesy as column expressions: distances, projections, cells and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean Earth radius, WGS84 axes, UTM scale, search-window degree.
EARTH_RADIUS_M = 6_371_008.8
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
METRES_PER_DEGREE_LATITUDE = 111_320.0
CELL_SIZE_M = 50_000.0

_E2 = WGS84_F * (2 - WGS84_F)
_E = math.sqrt(_E2)
_N = WGS84_F / (2 - WGS84_F)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; the argument is clipped so rounding cannot yield NaN."""
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def coordinate_defect(lon: Column, lat: Column) -> Column:
    """Name why a coordinate is unusable, or NULL when it is fine."""
    def not_finite(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    return F.when(not_finite(lon) | not_finite(lat), "non_finite").when(
        (F.abs(lon) > 180) | (F.abs(lat) > 90), "out_of_bounds"
    )


def latitude_band(lat: Column, degrees: float) -> Column:
    """Sortable fixed-width band label such as ``+035.00..+040.00``."""
    low = F.floor(lat / degrees) * F.lit(float(degrees))
    return F.format_string("%+07.2f..%+07.2f", low, low + float(degrees))


def equal_area_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:6933 easting and northing (ellipsoidal cylindrical equal-area, 30 degrees)."""
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - _E2 * math.sin(math.radians(30)) ** 2)
    sine = F.sin(F.radians(lat))
    q = (1 - _E2) * (
        sine / (1 - _E2 * sine * sine)
        - F.log((1 - _E * sine) / (1 + _E * sine)) / (2 * _E)
    )
    return WGS84_A * k0 * F.radians(lon), WGS84_A * q / (2 * k0)


def spatial_cell(x: Column, y: Column, size_m: float = CELL_SIZE_M) -> Column:
    """Key of the equal-area square holding (x, y)."""
    def index(c: Column) -> Column:
        return F.floor(c / size_m).cast("bigint").cast("string")

    return F.concat_ws(":", F.lit("epsg6933"), index(x), index(y))


def lonlat_cell(lon: Column, lat: Column, size_m: float = CELL_SIZE_M) -> Column:
    return spatial_cell(*equal_area_xy(lon, lat), size_m)


def utm_inverse_coefficients() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the published fourth-order inverse series terms."""
    n = _N
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return radius, beta, delta


def add_lonlat(
    df: DataFrame, epsg: Column, easting: Column, northing: Column,
    lon: str = "longitude", lat: str = "latitude",
) -> DataFrame:
    """Add longitude and latitude degrees of UTM points given their 326zz / 327zz code.

    Every step of the series is a column of its own: written as one expression the
    shared parts would be repeated dozens of times in the generated code.
    """
    radius, beta, delta = utm_inverse_coefficients()
    false_northing = F.when(epsg >= 32700, F.lit(10_000_000.0)).otherwise(F.lit(0.0))
    staged = df.withColumns({
        "__xi": (northing - false_northing) / (UTM_SCALE * radius),
        "__eta": (easting - 500_000.0) / (UTM_SCALE * radius),
        "__zone": epsg % 100,
    })
    xi, eta = F.col("__xi"), F.col("__eta")
    xi_p, eta_p = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_p = xi_p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_p = eta_p - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    staged = staged.withColumns({"__xi_p": xi_p, "__eta_p": eta_p})
    staged = staged.withColumns({
        "__chi": F.asin(F.sin("__xi_p") / F.cosh("__eta_p")),
        lon: F.col("__zone") * 6 - 183 + F.degrees(F.atan2(F.sinh("__eta_p"), F.cos("__xi_p"))),
    })
    latitude = F.col("__chi")
    for j, d in enumerate(delta, start=1):
        latitude = latitude + d * F.sin(2 * j * F.col("__chi"))
    return staged.withColumn(lat, F.degrees(latitude)).drop(
        "__xi", "__eta", "__zone", "__xi_p", "__eta_p", "__chi"
    )


def mgrs_epsg(tile: Column) -> Column:
    """EPSG code of an MGRS tile: latitude letters from N on are northern."""
    zone = F.substring(tile, 1, 2).cast("int")
    return F.when(F.substring(tile, 3, 1) >= "N", zone + 32600).otherwise(zone + 32700)


def place_bbox(lon: Column, lat: Column, size_m: float) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a square search window around a place."""
    half_lat = F.lit(size_m / 2 / METRES_PER_DEGREE_LATITUDE)
    half_lon = half_lat / F.cos(F.radians(lat))
    return lon - half_lon, lat - half_lat, lon + half_lon, lat + half_lat


def bbox_defect(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Name why a lon/lat box is invalid, or NULL when it is fine."""
    def not_finite(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    bad = not_finite(west) | not_finite(south) | not_finite(east) | not_finite(north)
    return (
        F.when(bad, "non_finite")
        .when(~((west >= -180) & (west < east) & (east <= 180)), "longitude_order")
        .when(~((south >= -90) & (south < north) & (north <= 90)), "latitude_order")
    )
