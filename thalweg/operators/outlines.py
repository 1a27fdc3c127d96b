"""Rings around cells of one label, tile by tile.

A side of a cell that its neighbour of the same label does not share is an edge, with the cell on
its right. The edge that follows is told by the cells around its end: it turns right where it can,
so cells that touch by a corner alone have rings of their own. A tile follows its edges as far
as it holds them; such stretches, one for each place where a ring enters a tile, form cycles that
are numbered by doubling. Only border cells and edges are shuffled after the first grouping by tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import flow as walks
from . import graphs
from .tiles import SIDE

#: Sides of a cell clockwise from the top: (corner where the edge begins, step ahead, step to the left of it).
_SIDES = [((0, 0), (0, 1), (-1, 0)), ((0, 1), (1, 0), (0, 1)), ((1, 1), (0, -1), (1, 0)), ((1, 0), (-1, 0), (0, -1))]


def _shift(a: np.ndarray, step: tuple[int, int]) -> np.ndarray:
    """What each cell's neighbour at ``step`` has; -1 beyond."""
    out = np.full_like(a, -1)
    h, w = a.shape
    dr, dc = step
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = a[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)]
    return out


def edges(cells: DataFrame, n_cols: int, label: str = "label", side: int = SIDE) -> DataFrame:
    """label, edge, next, first, place: each side of a cell that bounds its label, the one that follows, the first edge of its stretch, its place in it.

    An edge is 4 x cell + side. A ring that stays in a tile is a stretch that closes.
    """
    kind = dict(cells.dtypes)[label]

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * side - 1, int(key[1]) * side - 1
        code, names = pd.factorize(group["label"])
        grid = np.full((side + 2, side + 2), -1, np.int64)
        grid[group["row_i"].to_numpy(np.int64) - top, group["col_i"].to_numpy(np.int64) - left] = code
        own = np.zeros(grid.shape, bool)
        own[1:-1, 1:-1] = grid[1:-1, 1:-1] >= 0
        number = (np.arange(side + 2)[:, None] + top) * n_cols + np.arange(side + 2)[None, :] + left
        made = []
        for k, (_, ahead, out) in enumerate(_SIDES):
            bound = own & (_shift(grid, out) != grid)
            on = _shift(grid, ahead) == grid
            across = on & (_shift(grid, (ahead[0] + out[0], ahead[1] + out[1])) == grid)
            here = number * 4
            straight = here + 4 * (ahead[0] * n_cols + ahead[1]) + k
            turned = here + 4 * ((ahead[0] + out[0]) * n_cols + ahead[1] + out[1]) + (k - 1) % 4
            follow = np.where(across, turned, np.where(on, straight, here + (k + 1) % 4))
            made.append((here[bound] + k, follow[bound], grid[bound]))
        edge, follow, which = (np.concatenate(x) for x in zip(*made))
        order = np.argsort(edge)
        edge, follow, which = edge[order], follow[order], which[order]
        at = np.minimum(np.searchsorted(edge, follow), max(len(edge) - 1, 0))
        inside = edge[at] == follow if len(edge) else np.zeros(0, bool)
        first, place = _stretches(np.where(inside, at, -1))
        return pd.DataFrame({"label": names[which], "edge": edge, "next": follow, "first": edge[first], "place": place})

    row, col = F.col("row_i"), F.col("col_i")
    known = cells.where(F.col(label).isNotNull()).select("row_i", "col_i", F.col(label).alias("label"))
    # A cell goes to the tiles that it touches; those inside a tile to theirs only.
    span = lambda v: F.explode(F.sequence(F.floor((v - 1) / side), F.floor((v + 1) / side)))
    dealt = known.withColumn("ty", span(row)).withColumn("tx", span(col))
    return dealt.groupBy("ty", "tx").applyInPandas(solve, f"label {kind}, edge long, next long, first long, place long")


def _stretches(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, steps from it) of the chains in ``follow`` (-1 at their ends); a closed chain begins at its smallest."""
    n = len(follow)
    back = np.full(n, -1)
    back[follow[follow >= 0]] = np.flatnonzero(follow >= 0)
    # Closed chains are opened before their smallest place.
    least, ptr = np.arange(n), np.where(back >= 0, back, np.arange(n))
    for _ in range(max(n, 1).bit_length()):
        least = np.minimum(least, least[ptr])
        ptr = ptr[ptr]
    closed = back[ptr] >= 0
    back = np.where(closed & (least == np.arange(n)), -1, back)
    first, steps = np.where(back >= 0, back, np.arange(n)), (back >= 0).astype(np.int64)
    for _ in range(max(n, 1).bit_length()):
        steps = steps + steps[first]
        first = first[first]
    return first, steps


def rings(cells: DataFrame, n_cols: int, label: str = "label", side: int = SIDE) -> DataFrame:
    """label, ring, vidx, r, c: closed rings through the corners of areas of one label (row_i, col_i, ``label``), holes too.

    A ring runs with its label on the right, from its smallest edge, whose number it has; its last
    corner is its first. Cells that touch by a side are together. Cells without a label have no ring.
    """
    every = cut(edges(cells, n_cols, label, side), "sides")
    last = F.max(F.struct("place", "next"))
    stretch = cut(every.groupBy("first").agg(last.alias("l"), F.min("edge").alias("least"), F.min_by("place", "edge").alias("at")).select("first", F.col("l.next").alias("ptr"), (F.col("l.place") + 1).alias("n"), "least", "at"), "stretches")
    # Most rings close in a tile and are done.
    done = stretch.where("ptr = first").select("first", F.col("least").alias("ring"), F.lit(0).cast("long").alias("before"), F.col("n").alias("total"), F.col("at").alias("start"))
    open_ = stretch.where("ptr <> first")
    if not open_.isEmpty():
        minima = graphs.cycle_minima(open_.select(F.col("first").alias("node"), "ptr", F.col("least").alias("value")))
        known = cut(open_.withColumnRenamed("least", "mine").join(minima.withColumnsRenamed({"node": "first", "least": "ring"}), "first"), "cycles")
        heads = known.where("mine = ring").select("ring", F.col("first").alias("head"), F.col("at").alias("start"))
        headed = known.join(heads, "ring")
        # The way round is opened before the stretch that holds the smallest edge; sums along it are places.
        chain = headed.select(F.col("first").alias("node"), F.when(F.col("ptr") != F.col("head"), F.col("ptr")).alias("ptr"), F.col("n").alias("acc"))
        summed = walks.gathered(chain).withColumnsRenamed({"node": "first", "acc": "upto"})
        placed = headed.join(summed, "first")
        total = placed.groupBy("ring").agg(F.max("upto").alias("total"))
        done = done.unionByName(placed.join(total, "ring").select("first", "ring", (F.col("upto") - F.col("n")).alias("before"), "total", "start"))
    # Numbers take a byte or so in a file: without the hint either side might be broadcast.
    met = every.join(done.hint("merge"), "first")
    vidx = F.pmod(F.col("before") + F.col("place") - F.col("start"), F.col("total"))
    cell, k = F.shiftright("edge", 2), F.col("edge") % 4
    r = F.floor(cell / n_cols) + F.when(k.isin(2, 3), 1).otherwise(0)
    c = cell % n_cols + F.when(k.isin(1, 2), 1).otherwise(0)
    # The first corner stands at the end, too.
    places = F.when(vidx == 0, F.array(vidx, F.col("total"))).otherwise(F.array(vidx))
    return met.select("label", "ring", F.explode(places).alias("vidx"), r.alias("r"), c.alias("c"))
