"""Repaired polygons by areas known or counted on a fine grid of points."""

import numpy as np
import pytest

from thalweg.operators import checks, grid, repair

SCHEMA = "fid long, part int, ring int, vidx long, x double, y double"


def long(shapes):
    return [(fid, part, ring, i, float(x), float(y)) for fid, rings in shapes.items() for (part, ring), corners in rings.items() for i, (x, y) in enumerate([*corners, corners[0]])]


def areas(spark, shapes, cell=5.0):
    found, notes = repair.repaired(spark.createDataFrame(long(shapes), SCHEMA), cell)
    rows = found.collect()
    got = {r["fid"]: r["area_m2"] for r in grid.ring_areas(spark.createDataFrame(rows, SCHEMA)).collect()}
    return got, {r["fid"] for r in notes.collect()}, rows


def test_known_areas(spark):
    shapes = {
        1: {(0, 0): [(0, 0), (10, 10), (10, 0), (0, 10)]},  # a bow tie: two triangles
        2: {(0, 0): [(0, 0), (10, 0), (10, 10), (4, 10), (4, 4), (14, 4), (14, 14), (0, 14)]},  # a ring over itself: the part that it covers twice is out
        3: {(0, 0): [(0, 0), (8, 0), (8, 8), (0, 8)], (0, 1): [(2, 2), (2, 4), (4, 4), (4, 2)]},  # sound, with a hole
        4: {(0, 0): [(0, 0), (8, 0), (8, 8), (0, 8)], (0, 1): [(6, 2), (6, 4), (12, 4), (12, 2)]},  # a hole that leaves the outside
        5: {(0, 0): [(0, 0), (6, 0), (6, 6), (0, 6)], (1, 0): [(6, 0), (12, 0), (12, 6), (6, 6)]},  # parts with a common side
        6: {(0, 0): [(0, 0), (9, 0), (9, 3), (4, 3), (4, 8), (4, 3), (0, 3)]},  # a spike
    }
    got, notes, rows = areas(spark, shapes)
    # Of 2: 14 x 14 less the corner cut (10..14 x 0..4) and what even-odd leaves out, counted below.
    assert got[1] == pytest.approx(50) and got[3] == pytest.approx(60) and got[5] == pytest.approx(72) and got[6] == pytest.approx(27)
    assert got[4] == pytest.approx(64 - 4 + 8) and got[2] == pytest.approx(counted(shapes[2]), abs=0.5)
    assert notes == {1, 2, 4, 5, 6}
    assert {r["part"] for r in rows if r["fid"] == 1} == {0, 1} and {r["ring"] for r in rows if r["fid"] == 3} == {0, 1}


def counted(rings, step=0.05):
    """Area of the even-odd region by points of a fine grid, off all corners."""
    at = np.arange(-20, 40, step) + 0.0123
    x, y = np.meshgrid(at, at)
    odd = np.zeros(x.shape, bool)
    for corners in rings.values():
        for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd.sum() * step * step


def test_rings_of_chance(spark):
    rng = np.random.default_rng(5)
    shapes = {fid: {(0, ring): [tuple(p) for p in np.round(rng.uniform(-15, 35, (int(rng.integers(4, 10)), 2)), 1)] for ring in range(2)} for fid in range(6)}
    got, notes, rows = areas(spark, shapes)
    for fid, rings in shapes.items():
        assert got[fid] == pytest.approx(counted(rings, 0.04), rel=0.01)
    again, notes, _ = areas_of(spark, rows)
    assert again == pytest.approx(got)


def areas_of(spark, rows):
    """What is repaired bounds the same region once more."""
    found, notes = repair.repaired(spark.createDataFrame(rows, SCHEMA), 7.0)
    return {r["fid"]: r["area_m2"] for r in grid.ring_areas(found).collect()}, notes, None


def test_usable_repairs_before_it_judges(spark):
    shapes = {1: {(0, 0): [(0, 0), (10, 10), (10, 0), (0, 10)]}, 2: {(0, 0): [(0, 0), (5, 0), (9, 0)]}, 3: {(0, 0): [(0, 0), (1, 0), (1, 1)]}}
    sound, faults = checks.usable(spark.createDataFrame(long(shapes), SCHEMA), cell=5.0)
    assert {r["fid"] for r in sound.collect()} == {1, 3} and {r["fid"] for r in faults.collect()} == {2}
    plain, faults = checks.usable(spark.createDataFrame(long(shapes), SCHEMA))
    assert {r["fid"] for r in plain.collect()} == {3}
    assert repair.repaired(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_edges_of_many_polygons_are_not_broadcast(spark):
    """Edges grow when they are dealt to squares, shapes with the polygons."""
    squares = {i: {(0, 0): [(9 * i, 0), (9 * i + 8, 0), (9 * i + 8, 8), (9 * i, 8)]} for i in range(20)}
    rings = spark.createDataFrame(long(squares), SCHEMA)
    met = repair.meetings(repair._edges(rings), 5.0)
    once, gone = grid.first_of_each_shape(rings)
    assert (met.count(), once.count(), gone.count()) == (0, 100, 0)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (met, gone)]
    assert not any("BroadcastHashJoin" in p for p in plans)
