"""D8 flow on grids: directions, confluences, accumulation, sub-basins, outlets and outlines.

A cell is a number (row x columns + column). Walks along the flow are pointer doublings: every
round, each cell's pointer jumps twice as far, so a path of length L takes log2(L) rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

# Fixed values: (row step, column step) of each code.
OFFSETS = {
    "esri": {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)},
    "saga": {0: (-1, 0), 1: (-1, 1), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (1, -1), 6: (0, -1), 7: (-1, -1)},
    "grass": {1: (-1, 1), 2: (-1, 0), 3: (-1, -1), 4: (0, -1), 5: (1, -1), 6: (1, 0), 7: (1, 1), 8: (0, 1)},
}
#: Outlets keep this distance, in cells on one axis at least.
SPACING = 20
LEAST_CELLS = 50
#: Cells on a side of the tiles in which points are snapped.
TILE = 1024


def encoding(cells: DataFrame) -> DataFrame:
    """One row, ``encoding``: told by the codes there are; ``error`` where they fit none."""
    v = F.col("fdir")
    seen = cells.where("fdir is not null").agg(
        F.bool_or(v.isin(16, 32, 64, 128)).alias("esri"), F.bool_or(v == 0).alias("zero"), F.max(v).alias("top"), F.bool_and(v.between(1, 8)).alias("small"),
    )
    return seen.select(F.when(F.col("esri"), "esri").when(F.col("zero") & (F.col("top") <= 7), "saga").when(F.col("small"), "grass").otherwise("error").alias("encoding"))


def downstream(cells: DataFrame, n_rows: int, n_cols: int, code: str = "grass") -> DataFrame:
    """src, dst: where each cell drains; a cell that drains off the grid, or has no known code, drains to itself."""
    table = F.create_map(*[F.lit(x) for k, (dy, dx) in OFFSETS[code].items() for x in (k, dy * 1000 + dx)])
    # Both steps in one number: rows in thousands. The column step is -1, 0 or 1.
    both = F.try_element_at(table, F.col("fdir").cast("int"))
    dy = F.round(both / 1000).cast("int")
    row, col = F.col("row_i") + dy, F.col("col_i") + (both - dy * 1000)
    inside = both.isNotNull() & row.between(0, n_rows - 1) & col.between(0, n_cols - 1)
    return cells.select(F.col("src"), F.when(inside, row * n_cols + col).otherwise(F.col("src")).alias("dst"))


def confluences(flow: DataFrame, facc: DataFrame) -> DataFrame:
    """src, dst, facc, n_in, main_stem of cells that drain to a place with two inflows or more; the main stem has the most."""
    w = Window.partitionBy("dst")
    inflow = flow.where("src <> dst").join(facc, "src", "left").withColumn("facc", F.coalesce("facc", F.lit(0.0)))
    ranked = inflow.withColumn("n_in", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("facc"), "src")))
    return ranked.where("n_in >= 2").select("src", "dst", "facc", "n_in", (F.col("r") == 1).alias("main_stem"))


def accumulation(flow: DataFrame, limit: int = 40) -> DataFrame:
    """src, facc: the number of cells that drain through each, itself included. For any graph; grids have ``tiles.accumulation``."""
    start = flow.select(F.col("src").alias("node"), F.when(F.col("dst") != F.col("src"), F.col("dst")).alias("ptr"), F.lit(1).cast("long").alias("acc"))
    return gathered(start, limit).select(F.col("node").alias("src"), F.col("acc").cast("double").alias("facc"))


def gathered(nodes: DataFrame, limit: int = 40) -> DataFrame:
    """node, acc: the sum of ``acc`` over each node (node, ptr, acc) and all that point to it, at any distance.

    Each round adds to a node what its pointers' holders have gathered, and doubles the pointers;
    nodes whose pointers have ended only receive. Nodes on a cycle have no end: after ``limit``
    rounds the job stops with an error.
    """
    state = cut(nodes.select("node", "ptr", "acc"), "flow")
    for _ in range(limit):
        moving = state.where("ptr is not null")
        if moving.isEmpty():
            return state.select("node", "acc")
        sent = moving.groupBy(F.col("ptr").alias("node")).agg(F.sum("acc").alias("got"))
        further = moving.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"))
        hopped = moving.join(further, "ptr", "left").select("node", F.col("next").alias("ptr"), "acc")
        every = hopped.unionByName(state.where("ptr is null"))
        state = cut(every.join(sent, "node", "left").select("node", "ptr", (F.col("acc") + F.coalesce("got", F.lit(0).cast("long"))).alias("acc")), "flow")
    raise ValueError("the flow has cycles")


def path(flow: DataFrame, start: int, limit: int = 64) -> DataFrame:
    """node, step: the cells from ``start`` down, by doubling: each round the path's tail is as long as the path so far."""
    hop = cut(flow.select("src", F.col("dst").alias("next")), "hops")
    seen = cut(flow.where(F.col("src") == start).select(F.col("src").alias("node"), F.lit(0).cast("long").alias("step")), "path")
    length = 1
    for _ in range(limit):
        # Every known cell's jump of ``length`` steps is a new cell, or the sink again.
        new = seen.join(hop, seen["node"] == hop["src"]).select(F.col("next").alias("node"), (F.col("step") + length).alias("step"))
        both = cut(seen.unionByName(new).groupBy("node").agg(F.min("step").alias("step")), "path")
        if both.count() == seen.count():
            return both
        seen = both
        hop = cut(hop.alias("a").join(hop.alias("b"), F.col("a.next") == F.col("b.src")).select("a.src", "b.next"), "hops")
        length *= 2
    return seen


def labelled(flow: DataFrame, seeds: DataFrame, limit: int = 64) -> DataFrame:
    """node, label: that of the first seed on the way down; 0 for cells whose flow meets none.

    ``seeds``: node, label; of seeds at one cell the largest label holds. Cells of a cycle without
    a seed stay 0.
    """
    one = seeds.groupBy("node").agg(F.max("label").cast("long").alias("label"))
    start = flow.join(one, flow["src"] == one["node"], "left").select(F.col("src").alias("node"), F.when(F.col("label").isNull() & (F.col("dst") != F.col("src")), F.col("dst")).alias("ptr"), "label")
    state = cut(start, "labels")
    for _ in range(limit):
        at = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("label").alias("got"))
        following = state.join(at, "ptr", "left").select(
            "node", F.when(F.coalesce("label", "got").isNull(), F.col("next")).alias("ptr"), F.coalesce("label", "got").alias("label")
        )
        before, state = state, cut(following, "labels")
        if state.where("ptr is not null").isEmpty() or before.where("label is null").count() == state.where("label is null").count() and _same_ends(before, state):
            break
    return state.select("node", F.coalesce("label", F.lit(0).cast("long")).alias("label"))


def _same_ends(a: DataFrame, b: DataFrame) -> bool:
    """Whether two rounds have the same pointers, by an order-free checksum."""
    check = lambda d: d.where("ptr is not null").agg(F.bit_xor(F.xxhash64("node", "ptr")), F.count("*")).first()
    return tuple(check(a)) == tuple(check(b))


def with_trunk(trunk: DataFrame, seeds: DataFrame, main: int) -> DataFrame:
    """Seeds (node, label, place in the list) with ``trunk``, the whole path down from the main outlet's cell, under its label.

    Seeds listed after the main one keep their own cells on that path; those before are overruled.
    """
    mine = seeds.where(F.col("node") == main).select("label", "place")
    trunk = trunk.select("node").crossJoin(F.broadcast(mine))  # one row
    rest = seeds.where(F.col("node") != main)
    best = trunk.unionByName(rest.select("node", "label", "place"), allowMissingColumns=True)
    return best.groupBy("node").agg(F.max_by("label", "place").alias("label"))


def subbasins(labels: DataFrame, facc: DataFrame, n_cols: int, cell_m2: float, x_of=None, y_of=None, least_cells: int = LEAST_CELLS) -> DataFrame:
    """label_id, n_pixels, area_m2, area_km2, outlet_row, outlet_col (and outlet_x, outlet_y), rank: labels of ``least_cells`` or more.

    The outlet is the cell with the most accumulation, the first of equals; ranks go by area.
    """
    met = labels.where("label > 0").join(facc, labels["node"] == facc["src"], "left")
    found = met.groupBy("label").agg(F.count("*").alias("n_pixels"), F.max_by("node", F.struct(F.coalesce("facc", F.lit(-1.0)), -F.col("node"))).alias("cell"))
    row, col = F.floor(F.col("cell") / n_cols), F.col("cell") % n_cols
    out = found.where(F.col("n_pixels") >= least_cells).select(
        F.col("label").alias("label_id"), "n_pixels", F.round(F.col("n_pixels") * cell_m2, 1).alias("area_m2"), F.round(F.col("n_pixels") * cell_m2 / 1e6, 4).alias("area_km2"),
        row.alias("outlet_row"), col.alias("outlet_col"), *([F.round(x_of(col), 4).alias("outlet_x"), F.round(y_of(row), 4).alias("outlet_y")] if x_of else []),
    )
    # Ranks over the sub-basins kept: one row each, far fewer than cells.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("area_m2"), "label_id")))


def auto_outlet(facc: DataFrame, n_rows: int, n_cols: int, margin: int = 20) -> DataFrame:
    """row_i, col_i, facc of the cell with the most accumulation, away from the edges where the grid is large enough."""
    row, col = F.floor(F.col("src") / n_cols), F.col("src") % n_cols
    cells = facc.withColumn("row_i", row).withColumn("col_i", col)
    if n_rows > 2 * margin and n_cols > 2 * margin:
        cells = cells.where(F.col("row_i").between(margin, n_rows - margin - 1) & F.col("col_i").between(margin, n_cols - margin - 1))
    return cells.agg(F.max_by(F.struct("row_i", "col_i", "facc"), F.when(F.col("facc").isNotNull(), F.struct("facc", -F.col("src")))).alias("b")).where("b is not null").select("b.*")


def snapped_outlets(points: DataFrame, facc: DataFrame, n_cols: int, radius: int = 25) -> DataFrame:
    """fid, row_i, col_i of outlet points moved to the cell with the most accumulation within ``radius`` cells.

    Places and the cells around them go to tiles; in a tile the best cell around each place is a running
    maximum, so the work does not grow with the radius. Without a known cell near a point stays.
    """
    tile = lambda c: F.floor(c / TILE)
    near = lambda c: F.explode(F.sequence(tile(F.col(c) - radius), tile(F.col(c) + radius)))
    cells = facc.where("facc is not null").select("src", F.col("facc").cast("double").alias("facc"), F.floor(F.col("src") / n_cols).alias("r"), (F.col("src") % n_cols).alias("c"))
    cells = cells.withColumn("tr", near("r")).withColumn("tc", near("c"))
    places = points.where("row_i is not null and col_i is not null").select(F.col("row_i").cast("long").alias("row_i"), F.col("col_i").cast("long").alias("col_i")).distinct()
    places = places.withColumn("tr", tile(F.col("row_i"))).withColumn("tc", tile(F.col("col_i")))

    def best(cells: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or places.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("row_i", "col_i", "r", "c")})
        cells = cells.sort_values(["facc", "src"], ascending=[True, False])
        top, left = (int(places[t].iloc[0]) * TILE for t in ("tr", "tc"))
        rank = np.full((TILE + 2 * radius, TILE + 2 * radius), -1, np.int32)
        rank[cells["r"] - top + radius, cells["c"] - left + radius] = np.arange(len(cells), dtype=np.int32)
        most = _running_max(_running_max(rank, 2 * radius + 1).T, 2 * radius + 1).T[places["row_i"] - top, places["col_i"] - left]
        at = cells[["r", "c"]].to_numpy()[most[most >= 0]]
        return places.loc[most >= 0, ["row_i", "col_i"]].assign(r=at[:, 0], c=at[:, 1])

    found = cells.groupBy("tr", "tc").cogroup(places.groupBy("tr", "tc")).applyInPandas(best, "row_i long, col_i long, r long, c long")
    return points.join(found, ["row_i", "col_i"], "left").select("fid", F.coalesce("r", "row_i").alias("row_i"), F.coalesce("c", "col_i").alias("col_i"))


def _running_max(a: np.ndarray, n: int) -> np.ndarray:
    """The most of each ``n`` rows that follow one another, by doubling."""
    width = 1
    while 2 * width <= n:
        a, width = np.maximum(a[:-width], a[width:]), 2 * width
    return np.maximum(a[: len(a) - (n - width)], a[n - width :])


def with_own_outlet(found: DataFrame, node: int, area_m2: float) -> DataFrame:
    """The outlets, and a cell of the user's own unless it is among them."""
    mine = found.sparkSession.createDataFrame([(node, node, area_m2, "outlet")], "node long, dst long, area_m2 double, kind string")
    last = found.agg((F.coalesce(F.max("place"), F.lit(-1)) + 1).alias("place"))
    return found.unionByName(mine.join(found, "node", "left_anti").crossJoin(F.broadcast(last)))


def outline_edges(cells: DataFrame, label: str = "label") -> DataFrame:
    """label, r0, c0, r1, c1: sides of cells that no neighbour of the same label shares."""
    side = lambda a, b, c, d: F.struct((F.col("row_i") + a).alias("r0"), (F.col("col_i") + b).alias("c0"), (F.col("row_i") + c).alias("r1"), (F.col("col_i") + d).alias("c1"))
    sides = F.array(side(0, 0, 0, 1), side(1, 0, 1, 1), side(0, 0, 1, 0), side(0, 1, 1, 1))
    each = cells.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(sides).alias("e")).select("label", "e.*")
    return each.groupBy("label", "r0", "c0", "r1", "c1").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def rank_colour(rank: Column) -> Column:
    """#rrggbb of a rank: hues a golden ratio apart at one saturation and value."""
    hue = F.pmod(rank * 0.618033988749895 + 0.1, F.lit(1.0)) * 6
    part = hue - F.floor(hue)
    v, s = 0.90, 0.65
    p, q, t = F.lit(v * (1 - s)), v * (1 - s * part), v * (1 - s * (1 - part))
    ways = [(F.lit(v), t, p), (q, F.lit(v), p), (p, F.lit(v), t), (p, q, F.lit(v)), (t, p, F.lit(v)), (F.lit(v), p, q)]
    pick = lambda k: F.coalesce(*[F.when(F.floor(hue) == i, w[k]) for i, w in enumerate(ways)])
    return F.format_string("#%02x%02x%02x", *[F.round(pick(k) * 255).cast("int") for k in range(3)])
