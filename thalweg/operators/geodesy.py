"""Areas, lengths and map projections on the WGS84 ellipsoid, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the ellipsoid: equatorial radius in metres, flattening.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
N3 = FLATTENING / (2 - FLATTENING)


def _turn(longitudes: Column) -> Column:
    """A difference of longitudes in radians, the short way round."""
    return F.pmod(longitudes + math.pi, F.lit(2 * math.pi)) - math.pi


def authalic(lat: Column) -> Column:
    """Twice the height, in equatorial radii, of a latitude (radians) on the cylinder of equal areas."""
    s = F.sin(lat)
    return (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(E * s) / E)


def ring_areas(rings: DataFrame, signed: bool = False) -> DataFrame:
    """fid, area_m2, area_km2 of rings in degrees on the ellipsoid; rings after the first of a part are holes.

    Edges are straight on the cylinder of equal areas, as meridians and parallels are. A ring may
    cross the date line, but not hold a pole. ``signed`` areas are positive where a ring turns left
    on the cylinder and negative where it turns right, as holes that turn right and all beyond a pole do.
    """
    w = Window.partitionBy("fid", "part", "ring").orderBy("vidx")
    x, q = F.radians("x"), authalic(F.radians("y"))
    step = _turn(F.lead(x).over(w) - x) * (F.lead(q).over(w) + q) / 2
    each = rings.select("fid", "part", "ring", step.alias("s")).groupBy("fid", "part", "ring").agg((-F.sum("s") * (A * A / 2)).alias("a"))
    size = F.col("a") if signed else F.when(F.col("ring") == 0, F.abs("a")).otherwise(-F.abs("a"))
    total = each.groupBy("fid").agg(F.sum(size).alias("area_m2"))
    return total.withColumn("area_km2", F.col("area_m2") / 1e6)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres between two places in degrees, right to some metres in thousands of kilometres; not for places opposite to each other."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(y))) for y in (y1, y2))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    turn = _turn(F.radians(x2) - F.radians(x1)) / 2
    h = F.sin(q) * F.sin(q) + F.cos(b1) * F.cos(b2) * F.sin(turn) * F.sin(turn)
    angle = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    square = lambda c: c * c
    flat = (angle - F.sin(angle)) * square(F.sin(p)) * square(F.cos(q)) / square(F.cos(angle / 2))
    steep = (angle + F.sin(angle)) * square(F.cos(p)) * square(F.sin(q)) / F.when(h > 0, h)
    return F.when(h > 0, A * (angle - FLATTENING / 2 * (flat + steep))).otherwise(F.when(h.isNotNull(), F.lit(0.0)))


def line_lengths(vertices: DataFrame) -> DataFrame:
    """fid, length_m of lines (fid, vidx, x, y) in degrees."""
    w = Window.partitionBy("fid").orderBy("vidx")
    step = distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))
    return vertices.select("fid", step.alias("d")).groupBy("fid").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length_m"))


# Fixed values of the series of the transverse Mercator projection, in powers of the third flattening.
_FORWARD = (
    N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16 + 41 * N3**4 / 180,
    13 * N3**2 / 48 - 3 * N3**3 / 5 + 557 * N3**4 / 1440,
    61 * N3**3 / 240 - 103 * N3**4 / 140,
    49561 * N3**4 / 161280,
)
_BACK = (
    N3 / 2 - 2 * N3**2 / 3 + 37 * N3**3 / 96 - N3**4 / 360,
    N3**2 / 48 + N3**3 / 15 - 437 * N3**4 / 1440,
    17 * N3**3 / 480 - 37 * N3**4 / 840,
    4397 * N3**4 / 161280,
)
_LATITUDE = (
    2 * N3 - 2 * N3**2 / 3 - 2 * N3**3 + 116 * N3**4 / 45,
    7 * N3**2 / 3 - 8 * N3**3 / 5 - 227 * N3**4 / 45,
    56 * N3**3 / 15 - 136 * N3**4 / 35,
    4279 * N3**4 / 630,
)
_RADIUS = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)


@dataclass(frozen=True)
class System:
    """A coordinate system by its number: degrees (4326), web Mercator (3857) or a zone of the transverse Mercator (32601-32660 north, 32701-32760 south)."""

    code: int

    def __post_init__(self):
        if not (self.code in (4326, 3857) or self.code // 100 in (326, 327) and 1 <= self.code % 100 <= 60):
            raise ValueError(f"unknown coordinate system {self.code}")

    @property
    def geographic(self) -> bool:
        return self.code == 4326

    def _zone(self) -> tuple[float, float]:
        """(middle meridian in radians, what is added to northings)."""
        return math.radians(self.code % 100 * 6 - 183), 10_000_000.0 if self.code // 100 == 327 else 0.0

    def from_degrees(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        if self.geographic:
            return lon, lat
        if self.code == 3857:
            return F.radians(lon) * A, F.asinh(F.tan(F.radians(lat))) * A
        middle, north = self._zone()
        s, turn = F.sin(F.radians(lat)), _turn(F.radians(lon) - middle)
        t = F.sinh(F.atanh(s) - E * F.atanh(E * s))
        xi, eta = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
        y = xi + sum((k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(_FORWARD, 1)), F.lit(0.0))
        x = eta + sum((k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(_FORWARD, 1)), F.lit(0.0))
        return 500_000.0 + 0.9996 * _RADIUS * x, north + 0.9996 * _RADIUS * y

    def to_degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        if self.geographic:
            return x, y
        if self.code == 3857:
            return F.degrees(x / A), F.degrees(F.atan(F.sinh(y / A)))
        middle, north = self._zone()
        xi, eta = (y - north) / (0.9996 * _RADIUS), (x - 500_000.0) / (0.9996 * _RADIUS)
        xi2 = xi - sum((k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(_BACK, 1)), F.lit(0.0))
        eta2 = eta - sum((k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(_BACK, 1)), F.lit(0.0))
        chi = F.asin(F.sin(xi2) / F.cosh(eta2))
        lat = chi + sum((k * F.sin(2 * j * chi) for j, k in enumerate(_LATITUDE, 1)), F.lit(0.0))
        return F.degrees(_turn(middle + F.atan2(F.sinh(eta2), F.cos(xi2)))), F.degrees(lat)


def reprojected(points: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with ``x`` and ``y`` in another system; null stays null, systems that are not known are an error."""
    a, b = System(source), System(target)
    if source == target:
        return points
    tx, ty = b.from_degrees(*a.to_degrees(F.col(x), F.col(y)))
    return points.withColumns({x: tx, y: ty})
