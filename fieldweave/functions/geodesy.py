"""Transverse-Mercator projections as column expressions (Krüger 1912, in the series of Karney 2011), and UTM zones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The GRS80/WGS84 ellipsoid (their flattenings differ by less than the series resolves).
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: The coefficients of the published series, by power of n.
_FORWARD = [
    {1: 1 / 2, 2: -2 / 3, 3: 5 / 16, 4: 41 / 180, 5: -127 / 288},
    {2: 13 / 48, 3: -3 / 5, 4: 557 / 1440, 5: 281 / 630},
    {3: 61 / 240, 4: -103 / 140, 5: 15061 / 26880},
    {4: 49561 / 161280, 5: -179 / 168},
    {5: 34729 / 80640},
]
_BACK = [
    {1: 1 / 2, 2: -2 / 3, 3: 37 / 96, 4: -1 / 360, 5: -81 / 512},
    {2: 1 / 48, 3: 1 / 15, 4: -437 / 1440, 5: 46 / 105},
    {3: 17 / 480, 4: -37 / 840, 5: -209 / 4480},
    {4: 4397 / 161280, 5: -11 / 504},
    {5: 4583 / 161280},
]
_LATITUDE = [
    {1: 2.0, 2: -2 / 3, 3: -2.0, 4: 116 / 45, 5: 26 / 45},
    {2: 7 / 3, 3: -8 / 5, 4: -227 / 45, 5: 2704 / 315},
    {3: 56 / 15, 4: -136 / 35, 5: -1262 / 105},
    {4: 4279 / 630, 5: -332 / 35},
    {5: 4174 / 315},
]


def _sum(series: list[dict[int, float]]) -> list[float]:
    return [sum(c * _N**p for p, c in term.items()) for term in series]


ALPHA, BETA, DELTA = _sum(_FORWARD), _sum(_BACK), _sum(_LATITUDE)
_ROOT = 2 * _N**0.5 / (1 + _N)


@dataclass(frozen=True)
class Grid:
    """A transverse-Mercator grid; the central meridian may be a column."""

    meridian: float | Column
    scale: float
    east: float
    north: float | Column


#: The national grid used by field outlines in EPSG:2180.
EPSG_2180 = Grid(19.0, 0.9993, 500_000.0, -5_300_000.0)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone; no regional exceptions."""
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm(lon: Column, lat: Column) -> Grid:
    """The UTM grid of a point, usually a field's centroid."""
    return Grid(utm_zone(lon) * 6.0 - 183.0, 0.9996, 500_000.0, F.when(lat >= 0, 0.0).otherwise(10_000_000.0))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it: keeps the expression tree small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def grid_point(lon: Column, lat: Column, grid: Grid) -> Column:
    """(x, y) in metres as a struct."""
    def plane(s: Column) -> Column:
        x, y = s["eta"], s["xi"]
        for j, a in enumerate(ALPHA, 1):
            x = x + a * F.cos(2 * j * s["xi"]) * F.sinh(2 * j * s["eta"])
            y = y + a * F.sin(2 * j * s["xi"]) * F.cosh(2 * j * s["eta"])
        k = grid.scale * _RADIUS
        return F.struct((grid.east + k * x).alias("x"), (grid.north + k * y).alias("y"))

    def sphere(s: Column) -> Column:
        return F.struct(F.atan2(s["t"], F.cos(s["dl"])).alias("xi"), F.atanh(F.sin(s["dl"]) / F.sqrt(1 + s["t"] * s["t"])).alias("eta"))

    t = let(F.sin(F.radians(lat)), lambda s: F.sinh(F.atanh(s) - F.lit(_ROOT) * F.atanh(F.lit(_ROOT) * s)))
    return let(let(F.struct(t.alias("t"), F.radians(lon - grid.meridian).alias("dl")), sphere), plane)


def to_grid(lon: Column, lat: Column, grid: Grid) -> tuple[Column, Column]:
    """(east, north) in metres."""
    p = grid_point(lon, lat, grid)
    return p["x"], p["y"]


def from_grid(east: Column, north: Column, grid: Grid) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    def angles(s: Column) -> Column:
        x, y = s["xi"], s["eta"]
        for j, b in enumerate(BETA, 1):
            x = x - b * F.sin(2 * j * s["xi"]) * F.cosh(2 * j * s["eta"])
            y = y - b * F.cos(2 * j * s["xi"]) * F.sinh(2 * j * s["eta"])
        return F.struct(x.alias("x"), y.alias("y"))

    def degrees(s: Column) -> Column:
        def latitude(chi: Column) -> Column:
            phi = chi
            for j, d in enumerate(DELTA, 1):
                phi = phi + d * F.sin(2 * j * chi)
            return phi

        lat = let(F.asin(F.sin(s["x"]) / F.cosh(s["y"])), latitude)
        return F.struct((F.degrees(F.atan2(F.sinh(s["y"]), F.cos(s["x"]))) + grid.meridian).alias("lon"), F.degrees(lat).alias("lat"))

    k = grid.scale * _RADIUS
    p = let(let(F.struct(((north - grid.north) / k).alias("xi"), ((east - grid.east) / k).alias("eta")), angles), degrees)
    return p["lon"], p["lat"]
