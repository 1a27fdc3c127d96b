"""Zones by scanlines, outlines, parts and the sieve against plain versions, with tiles far smaller than what they hold."""

import numpy as np
import pytest

from thalweg.operators import grid, outlines, parts, zones


def cells_of(spark, values):
    rows = [(r, c, int(v)) for (r, c), v in np.ndenumerate(values) if v >= 0]
    return spark.createDataFrame(rows, "row_i long, col_i long, label long")


def picture(seed, rows=17, cols=23, values=3, gaps=0.05):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, values, (rows, cols))
    v = np.where(rng.random(v.shape) < 0.5, np.roll(v, 1, axis=1), v)
    return np.where(rng.random(v.shape) < gaps, -1, v)


def steps(diagonal):
    return [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and (diagonal or not dr * dc)]


def plain_parts(v, diagonal):
    """The first cell of each cell's part."""
    top = np.full(v.shape, -1)
    for r, c in np.ndindex(*v.shape):
        if v[r, c] < 0 or top[r, c] >= 0:
            continue
        top[r, c], stack = r * v.shape[1] + c, [(r, c)]
        while stack:
            y, x = stack.pop()
            for dr, dc in steps(diagonal):
                p = y + dr, x + dc
                if 0 <= p[0] < v.shape[0] and 0 <= p[1] < v.shape[1] and v[p] == v[r, c] and top[p] < 0:
                    top[p] = top[r, c]
                    stack.append(p)
    return top


@pytest.mark.parametrize("diagonal,side", [(False, 4), (True, 5), (True, 64)])
def test_parts(spark, diagonal, side):
    v = picture(1 + side)
    want = plain_parts(v, diagonal)
    got = {(r["row_i"], r["col_i"]): (r["label"], r["part"]) for r in parts.parts(cells_of(spark, v), "label", diagonal, side).collect()}
    key = lambda t: (int(t) // v.shape[1] << 31) + int(t) % v.shape[1]
    assert got == {(r, c): (v[r, c], key(want[r, c])) for r, c in np.ndindex(*v.shape) if v[r, c] >= 0}


def plain_sieve(v, least):
    v = v.copy()
    while True:
        top = plain_parts(v, True)
        size = {t: int((top == t).sum()) for t in np.unique(top[top >= 0])}
        value = {t: v.ravel()[t] for t in size}
        beside = {}
        for r, c in np.ndindex(*v.shape):
            for dr, dc in steps(True):
                p = r + dr, c + dc
                if top[r, c] >= 0 and 0 <= p[0] < v.shape[0] and 0 <= p[1] < v.shape[1] and top[p] >= 0 and top[p] != top[r, c]:
                    beside.setdefault(top[r, c], set()).add(top[p])
        to = {}
        for t, near in beside.items():
            larger = [(size[q], -q) for q in near if size[q] > size[t] or size[q] == size[t] and q < t]
            if size[t] < least and larger:
                to[t] = value[-max(larger)[1]]
        if not to:
            return v
        for t, x in to.items():
            v[top == t] = x


@pytest.mark.parametrize("seed,side,least", [(3, 4, 5), (4, 6, 12), (5, 64, 400)])
def test_sieve(spark, seed, side, least):
    v = picture(seed)
    got = {(r["row_i"], r["col_i"]): r["label"] for r in parts.sieved(cells_of(spark, v), least, "label", side=side).collect()}
    want = plain_sieve(v, least)
    assert got == {(r, c): want[r, c] for r, c in np.ndindex(*v.shape) if want[r, c] >= 0}


def test_names_and_nulls_as_values(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (0, 2, "b"), (1, 2, None), (1, 3, None), (2, 0, "a")], "row_i long, col_i long, label string")
    got = sorted((r["row_i"], r["col_i"], r["label"] or "", r["part"] & 7) for r in parts.parts(df, "label", side=2).collect())
    assert got == [(0, 0, "a", 0), (0, 1, "a", 0), (0, 2, "b", 2), (1, 2, "", 2), (1, 3, "", 3), (2, 0, "a", 0)]
    assert parts.parts(df.limit(0), "label").count() == 0 and parts.sieved(df.limit(0), 3, "label").count() == 0


def walked(v):
    """Rings by walking each edge to the right where it can go."""
    rows, cols = v.shape
    at = lambda r, c: v[r, c] if 0 <= r < rows and 0 <= c < cols else -1
    heads = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    left = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    begin = [(0, 0), (0, 1), (1, 1), (1, 0)]
    todo = {(r, c, k) for r, c in np.ndindex(rows, cols) for k in range(4) if v[r, c] >= 0 and at(r + left[k][0], c + left[k][1]) != v[r, c]}
    found = {}
    while todo:
        start = r, c, k = min(todo)
        corners = []
        while True:
            todo.discard((r, c, k))
            corners.append((r + begin[k][0], c + begin[k][1]))
            ahead, slant = (r + heads[k][0], c + heads[k][1]), (r + heads[k][0] + left[k][0], c + heads[k][1] + left[k][1])
            if at(*ahead) != v[start[:2]]:
                k = (k + 1) % 4
            elif at(*slant) != v[start[:2]]:
                r, c = ahead
            else:
                (r, c), k = slant, (k - 1) % 4
            if (r, c, k) == start:
                break
        found[4 * (start[0] * cols + start[1]) + start[2]] = (v[start[:2]], [*corners, corners[0]])
    return found


@pytest.mark.parametrize("seed,side,values", [(6, 4, 3), (7, 3, 2), (8, 64, 2)])
def test_rings(spark, seed, side, values):
    v = picture(seed, values=values)
    got = {}
    for r in outlines.rings(cells_of(spark, v), v.shape[1], side=side).orderBy("ring", "vidx").collect():
        got.setdefault(r["ring"], (r["label"], []))[1].append((r["r"], r["c"]))
    assert got == walked(v)


def test_one_long_ring_and_none(spark):
    """A spiral whose ring crosses tiles again and again."""
    v = np.full((13, 13), -1)
    r, c, dr, dc = 0, 0, 0, 1
    for n in (12, 12, 12, 10, 10, 8, 8, 6, 6):
        for _ in range(n):
            v[r, c] = 1
            r, c = r + dr, c + dc
        dr, dc = dc, -dr
    found = outlines.rings(cells_of(spark, v), 13, side=2).collect()
    assert {r["ring"] for r in found} == set(walked(v)) and len(found) == sum(len(x) for _, x in walked(v).values())
    assert outlines.rings(cells_of(spark, v).limit(0), 13).count() == 0


def test_zones_against_every_edge(spark):
    """Rings with holes, parts, touching corners and vertices on cell centres."""
    meta = grid.GridMeta(0.0, 10.0, 200.0, -10.0, n_rows=20, n_cols=25)
    rng = np.random.default_rng(2)
    rows = []
    for fid in range(12):
        for part in range(2):
            for ring in range(2):
                n = int(rng.integers(3, 8))
                corners = np.round(rng.uniform(-40, 290, (n, 2)) / 5) * 5
                rows += [(fid, part, ring, i, float(x), float(y)) for i, (x, y) in enumerate([*corners, corners[0]])]
    rings = spark.createDataFrame(rows, "fid long, part int, ring int, vidx long, x double, y double")
    cells = spark.createDataFrame([(r, c, float(r * c)) for r in range(20) for c in range(25) if (r + c) % 7], "row_i long, col_i long, z double")
    points = cells.withColumn("x", meta.x_of(cells["col_i"])).withColumn("y", meta.y_of(cells["row_i"]))
    want = sorted((r["fid"], r["row_i"], r["col_i"]) for r in grid.point_in_rings(points, rings, 40.0).collect())
    got = sorted((r["fid"], r["row_i"], r["col_i"]) for r in zones.cells_in_zones(cells, rings, meta).collect())
    assert got == want and len(got) > 300
    assert zones.cells_in_zones(cells, rings.limit(0), meta).count() == 0
