"""Flow from elevations against a plain priority flood and plain searches, with tiles far smaller than the flats."""

import heapq
import math

import numpy as np
import pytest

from thalweg.operators import filling, tiles


def plain(z, px):
    """(filled levels, next cell) of a grid; NaN cells are outside."""
    rows, cols = z.shape
    near = lambda r, c: [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b)]
    there = lambda r, c: 0 <= r < rows and 0 <= c < cols and not np.isnan(z[r, c])
    cells = [(r, c) for r in range(rows) for c in range(cols) if there(r, c)]
    beside = {p for p in cells if not all(there(*q) for q in near(*p))}
    level, heap = {}, [(z[p], p) for p in beside]
    heapq.heapify(heap)
    while heap:
        h, p = heapq.heappop(heap)
        if p in level:
            continue
        level[p] = h
        for q in near(*p):
            if there(*q) and q not in level:
                heapq.heappush(heap, (max(h, z[q]), q))
    number = lambda p: p[0] * cols + p[1]
    dst, front = {}, []
    for p in cells:
        drops = [((level[p] - level[q]) / math.hypot((q[0] - p[0]) * px[1], (q[1] - p[1]) * px[0]), -number(q)) for q in near(*p) if there(*q)]
        best = max(drops, default=(0, 0))
        if best[0] > 0:
            dst[p] = -best[1]
        elif p in beside:
            dst[p] = number(p)
    steps, front = {p: 0 for p in dst}, list(dst)
    while front:
        later = []
        for p in front:
            for q in near(*p):
                if there(*q) and q not in steps and level[q] == level[p]:
                    steps[q] = steps[p] + 1
                    later.append(q)
        front = later
    for p in cells:
        if p not in dst:
            dst[p] = min(number(q) for q in near(*p) if there(*q) and level[q] == level[p] and steps[q] == steps[p] - 1)
    return {number(p): (dst[p], level[p]) for p in cells}


def terrain(kind, seed, rows=21, cols=26):
    rng = np.random.default_rng(seed)
    if kind == "steps":  # few levels: wide flats and lakes
        z = rng.integers(0, 4, (rows, cols)).astype(float)
    elif kind == "bowl":  # one lake over many tiles
        r, c = np.mgrid[:rows, :cols]
        z = np.round(np.hypot(r - 10, c - 13) + rng.random((rows, cols)), 1)
    else:
        z = np.round(rng.random((rows, cols)) * 9 + np.add.outer(np.arange(rows), np.arange(cols)) * 0.1, 3)
    if seed % 2:
        z[rng.random(z.shape) < 0.06] = np.nan
    return z


@pytest.mark.parametrize("kind,seed,side", [("steps", 1, 4), ("steps", 2, 5), ("bowl", 3, 6), ("bowl", 4, 5), ("rough", 5, 7), ("rough", 6, 64)])
def test_flow_against_a_priority_flood(spark, kind, seed, side):
    z = terrain(kind, seed)
    px = (10.0, 12.0)
    cells = spark.createDataFrame([(i, None if np.isnan(v) and i % 2 else float(v)) for i, v in enumerate(z.ravel())], "src long, z double")
    got = {r["src"]: (r["dst"], r["level"]) for r in filling.flow(cells, z.shape[1], px, side).collect()}
    assert got == plain(z, px)


def test_accumulation_of_what_was_filled(spark):
    z = terrain("bowl", 7)
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z.ravel())], "src long, z double")
    found = filling.flow(cells, z.shape[1], side=5)
    acc = {r["src"]: r["facc"] for r in tiles.accumulation(found, z.shape[1], 5).collect()}
    want = dict.fromkeys(acc, 0)
    next_ = {k: d for k, (d, _) in plain(z, (1.0, 1.0)).items()}
    for at in next_:
        want[at] += 1
        while next_[at] != at:
            at = next_[at]
            want[at] += 1
    assert acc == want and sum(acc[k] for k, d in next_.items() if d == k) == len(acc)


def test_few_cells(spark):
    schema = "src long, z double"
    assert filling.flow(spark.createDataFrame([], schema), 5).count() == 0
    assert filling.flow(spark.createDataFrame([(3, None), (4, float("nan"))], schema), 5).count() == 0
    assert [tuple(r) for r in filling.flow(spark.createDataFrame([(7, 2.0)], schema), 5).collect()] == [(7, 7, 2.0)]


def test_merged_levels_by_hand():
    u, v = np.array([0, 1, 2, 0]), np.array([1, 2, 3, 3])
    level, source = filling.merged_levels(u, v, np.array([5.0, 2.0, 4.0, 9.0]), np.array([True, False, False, True]))
    assert level[1:3].tolist() == [4.0, 4.0] and source.tolist() == [0, 3, 3, 3]
