"""Known areas and lengths of the ellipsoid; projections by what defines them, and there and back."""

import math

import pytest
from pyspark.sql import functions as F

from thalweg.operators import geodesy

RING = "fid long, part int, ring int, vidx long, x double, y double"


def box(fid, x0, y0, x1, y1, ring=0):
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return [(fid, 0, ring, i, float(x), float(y)) for i, (x, y) in enumerate(corners)]


def test_known_areas(spark):
    rows = box(1, 0, 0, 90, 90) + box(2, 10, 0, 11, 1) + box(3, 179.5, 0, -179.5, 1) + box(4, 0, 0, 2, 1) + box(4, 0.5, 0.25, 1.5, 0.75, ring=1)
    got = {r["fid"]: r["area_km2"] for r in geodesy.ring_areas(spark.createDataFrame(rows, RING)).collect()}
    assert got[1] == pytest.approx(510065621.724 / 8, rel=1e-9)  # an eighth of the ellipsoid
    assert got[2] == pytest.approx(12308.778, rel=1e-4) and got[3] == pytest.approx(got[2], rel=1e-12)  # a degree by a degree (there with geodesic edges), across the date line too
    assert got[4] == pytest.approx(2 * got[2] - got[2] / 2, rel=1e-3)


def test_known_lengths(spark):
    lines = {1: [(0, 0), (1, 0)], 2: [(30, 0), (30, 90)], 3: [(179.5, 0), (-179.5, 0)], 4: [(5, 5), (5, 5)], 5: [(2.0, 48.0)], 6: [(2.352222, 48.856667), (-0.118092, 51.509865)]}
    rows = [(fid, i, float(x), float(y)) for fid, line in lines.items() for i, (x, y) in enumerate(line)]
    got = {r["fid"]: r["length_m"] for r in geodesy.line_lengths(spark.createDataFrame(rows, "fid long, vidx long, x double, y double")).collect()}
    assert got[1] == pytest.approx(111319.4908, abs=1e-3) and got[3] == pytest.approx(got[1], abs=1e-3)
    assert got[2] == pytest.approx(10001965.729, abs=60) and got[4] == got[5] == 0
    assert got[6] == pytest.approx(343_900, rel=2e-3)


@pytest.fixture(scope="module")
def degrees(spark):
    rows = [(float(x), float(y)) for x in (6.1, 7.5, 9.0, 10.2, 11.9) for y in (-79.0, -33.3, -0.5, 0.0, 12.0, 45.0, 63.2, 83.5)]
    return spark.createDataFrame(rows, "x double, y double").withColumns({"lon": F.col("x"), "lat": F.col("y")})


@pytest.mark.parametrize("code", [32632, 32732, 3857])
def test_there_and_back(degrees, code):
    for r in geodesy.reprojected(geodesy.reprojected(degrees, 4326, code), code, 4326).collect():
        assert abs(r["x"] - r["lon"]) * 111320 < 1e-3 and abs(r["y"] - r["lat"]) * 111320 < 1e-3  # a millimetre


def test_transverse_mercator(spark, degrees):
    """True to scale along its middle, where northings are arcs of the meridian, and conformal beside it."""
    there = {(r["lon"], r["lat"]): (r["x"], r["y"]) for r in geodesy.reprojected(degrees, 4326, 32632).collect()}
    assert there[9.0, 45.0] == pytest.approx((500_000.0, 0.9996 * 4984944.378), abs=2e-3)
    assert there[9.0, 0.0] == pytest.approx((500_000.0, 0.0), abs=1e-6)
    south = {(r["lon"], r["lat"]): r["y"] for r in geodesy.reprojected(degrees, 4326, 32732).collect()}
    assert south[9.0, -33.3] == pytest.approx(10_000_000 + there[9.0, -33.3][1], abs=1e-6)
    d = 1e-5
    near = spark.createDataFrame([(x + a, y + b) for x, y in ((6.1, 45.0), (11.9, 63.2)) for a, b in ((0, 0), (d, 0), (0, d))], "x double, y double")
    at = [(r["x"], r["y"]) for r in geodesy.reprojected(near, 4326, 32632).collect()]
    for k, lat in ((0, 45.0), (3, 63.2)):
        east, north = [complex(p[0] - at[k][0], p[1] - at[k][1]) for p in at[k + 1 : k + 3]]
        s = 1 - geodesy.E2 * math.sin(math.radians(lat)) ** 2
        along, across = geodesy.A * (1 - geodesy.E2) / s**1.5, geodesy.A / math.sqrt(s) * math.cos(math.radians(lat))
        assert north / along == pytest.approx(1j * east / across, rel=1e-5)


def test_unknown_systems_and_nulls(spark):
    for code in (4327, 32661, 32600, 27700):
        with pytest.raises(ValueError, match="unknown coordinate system"):
            geodesy.System(code)
    row = geodesy.reprojected(spark.createDataFrame([(None, 4.0)], "x double, y double"), 4326, 32632).first()
    assert row["x"] is None


def test_signed_areas_change_their_sign_beyond_a_pole(spark):
    """On the cylinder the parallels run backwards there: what turns left in degrees turns right."""
    rows = box(1, 0, 0, 1, 1) + box(2, 0, -100, 1, -99) + box(3, 0, -81, 1, -80)
    got = {r["fid"]: r["area_km2"] for r in geodesy.ring_areas(spark.createDataFrame(rows, RING), signed=True).collect()}
    assert got[1] == pytest.approx(12308.778, rel=1e-4)
    assert got[2] == pytest.approx(-got[3], rel=1e-9) and got[3] > 0
