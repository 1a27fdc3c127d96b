"""Outlets chosen block by block against one plain pass over all candidates in order."""

import numpy as np
import pytest

from thalweg.operators import flow, outlets

ROWS, COLS = 70, 90


def plain(dst, facc, mode, n_target, least, stems, edges):
    budget, taken = max(1, n_target - 1), []

    def free(node, but=None):
        r, c = divmod(node, COLS)
        return all(n == but or abs(r - n // COLS) >= flow.SPACING or abs(c - n % COLS) >= flow.SPACING for n, *_ in taken)

    cells = sorted(range(len(dst)), key=lambda i: (-facc[i], i))
    if edges:
        for i in (i for i in cells if dst[i] == i):
            if mode == "n" and len(taken) >= max(1, budget // 3) or mode == "area" and facc[i] < least:
                break
            if free(i):
                taken.append((i, i, facc[i], "edge"))
    inflow = {}
    for i in cells:
        if dst[i] != i:
            inflow.setdefault(dst[i], []).append(i)
    left, used = budget - len(taken), 0
    for i in (i for i in cells if dst[i] != i and inflow[dst[i]][0] != i):
        if mode == "n" and used >= left or mode == "area" and facc[i] < least:
            break
        if not free(i):
            continue
        taken.append((i, dst[i], facc[i], "internal"))
        used += 1
        stem = inflow[dst[i]][0]
        if stems and used < left and free(stem, but=i):
            taken.append((stem, dst[i], facc[stem], "main_stem"))
            used += 1
    return taken


def rivers(seed):
    """Cells drain south with turns by chance, so that rivers join; the last row leaves the grid."""
    rng = np.random.default_rng(seed)
    dst = []
    for i in range(ROWS * COLS):
        r, c = divmod(i, COLS)
        c2 = min(max(c + int(rng.integers(-1, 2)), 0), COLS - 1)
        dst.append(i if r == ROWS - 1 or rng.random() < 0.002 else (r + 1) * COLS + c2)
    facc = [1.0] * len(dst)
    for i in range(len(dst)):
        if dst[i] != i:
            facc[dst[i]] += facc[i]
    return dst, facc


@pytest.mark.parametrize("mode,n,least,stems,edges,block", [
    ("n", 25, 0, True, True, 24), ("n", 9, 0, False, False, 512), ("n", 1000, 0, True, True, 40), ("n", 2, 0, True, True, 512),
    ("area", 12, 6.0, True, True, 24), ("area", 1000, 2.0, True, False, 40), ("area", 3, 2.0, False, True, 40),
])
def test_against_one_pass(spark, mode, n, least, stems, edges, block):
    dst, facc = rivers(n)
    cells = spark.createDataFrame([(i, d) for i, d in enumerate(dst)], "src long, dst long")
    values = spark.createDataFrame(list(enumerate(facc)), "src long, facc double")
    found = outlets.outlets(cells, values, COLS, 1.0, mode, n, least, stems, edges, block).orderBy("place").collect()
    assert [(r["node"], r["dst"], r["area_m2"], r["kind"]) for r in found] == plain(dst, facc, mode, n, least, stems, edges)
    assert [r["place"] for r in found] == list(range(len(found)))


def test_no_cells_and_wrong_mode(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert outlets.outlets(none, spark.createDataFrame([], "src long, facc double"), 5, 1.0).count() == 0
    with pytest.raises(ValueError, match="mode"):
        outlets.outlets(none, none, 5, 1.0, mode="x")


def test_snapping_pairs_no_point_with_each_cell_around_it(spark):
    """Points on, off and beside a grid that several tiles share, against every pair; the plan joins points with their own answer only."""
    from thalweg.operators import flow

    n_cols, n_rows = 60, 1100
    facc = {r * n_cols + c: float((r * 37 + c * 91) % 53) for r in range(n_rows) for c in range(n_cols) if (r + c) % 7}
    cells = spark.createDataFrame(list(facc.items()), "src long, facc double")
    points = [(1, 0, 0), (2, 1023, 30), (3, 1024, 59), (4, 1030, -5), (5, -25, 70), (6, 5000, 5), (7, 1023, 30), (8, None, 3)]
    found = flow.snapped_outlets(spark.createDataFrame(points, "fid long, row_i long, col_i long"), cells, n_cols)

    def best(row, col):
        near = [] if row is None else [(v, -s) for s, v in facc.items() if abs(s // n_cols - row) <= 25 and abs(s % n_cols - col) <= 25]
        return divmod(-max(near)[1], n_cols) if near else (row, col)

    assert sorted(tuple(r) for r in found.collect()) == sorted((fid, *best(row, col)) for fid, row, col in points)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
