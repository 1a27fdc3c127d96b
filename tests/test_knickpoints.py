"""Breaks of chi profiles against a plain recursion with least squares."""

import numpy as np
import pytest

from thalweg.operators import fluvial


def plain(chi, elev, depth, points):
    out = []

    def rss(i, j):
        if abs(chi[i] - chi[j - 1]) < 1e-10:
            return np.inf
        a = np.stack([chi[i:j], np.ones(j - i)], axis=1)
        fit, *_ = np.linalg.lstsq(a, elev[i:j], rcond=None)
        return float(((a @ fit - elev[i:j]) ** 2).sum())

    def split(i, j, left):
        if left <= 0 or j - i <= 2 * points:
            return
        tried = [(rss(i, b) + rss(b, j), b) for b in range(i + points, j - points)]
        best = min(t for t in tried)
        if not np.isfinite(best[0]):
            return
        out.append(best[1])
        split(i, best[1], left - 1)
        split(best[1], j, left - 1)

    split(0, len(chi), depth)
    return sorted(set(out))[:depth]


@pytest.mark.parametrize("depth,points", [(1, 8), (3, 8), (4, 5)])
def test_against_a_recursion(spark, depth, points):
    rng = np.random.default_rng(depth)
    rows, want = [], {}
    for basin in range(12):
        n = int(rng.integers(2, 120))
        chi = np.cumsum(rng.random(n))[::-1]
        elev = np.interp(chi, np.sort(rng.random(5) * chi[0]), np.cumsum(rng.random(5) * 300)) + rng.normal(size=n)
        there = rng.random(n) > 0.1
        rows += [(basin, i, float(c) if ok else None, float(e)) for i, (c, e, ok) in enumerate(zip(chi, elev, there))]
        at = np.flatnonzero(there)
        want[basin] = [int(at[b]) for b in plain(chi[there], elev[there], depth, points)]
    rows += [(99, i, 1.0, float(i)) for i in range(50)]  # chi stands still: nothing to fit
    found = fluvial.knickpoints(spark.createDataFrame(rows, "basin_id long, idx long, chi double, elev double"), depth, points).collect()
    got = {b: sorted(r["idx"] for r in found if r["basin_id"] == b) for b in [*want, 99]}
    assert got == {**want, 99: []}


def test_no_levels_and_no_points(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i * i)) for i in range(40)], "basin_id long, idx long, chi double, elev double")
    assert fluvial.knickpoints(df, 0).count() == 0 and fluvial.knickpoints(df.limit(0), 3).count() == 0
