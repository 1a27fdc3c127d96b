"""D8 accumulation and labels tile by tile: each tile of the grid is solved in one pass, and only border cells meet across tiles.

A tile's flow that enters at a border cell leaves it at one other place. The border cells that are
entered therefore form a forest of their own, far smaller than the grid, which the general pointer
doublings of ``flow`` solve; a second pass brings what they found back into the tiles. The grid is
shuffled twice, whatever the length of its rivers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import flow as general

#: Cells of a tile's side: a task holds one tile's cells.
SIDE = 1024


def _tile(cell: Column, n_cols: int, side: int) -> list[Column]:
    return [F.floor(F.floor(cell / n_cols) / side).alias("ty"), F.floor((cell % n_cols) / side).alias("tx")]


def _border(cell: np.ndarray, n_cols: int, side: int) -> np.ndarray:
    row, col = cell // n_cols % side, cell % n_cols % side
    return (row == 0) | (row == side - 1) | (col == 0) | (col == side - 1)


def _places(src: np.ndarray, dst: np.ndarray, n_cols: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each cell's next one within the tile, -1 for none; whether it drains out of the tile). ``src`` is sorted.

    Flow to a cell of the tile that is not there ends, like flow to the cell itself.
    """
    at = np.minimum(np.searchsorted(src, dst), len(src) - 1)
    square = lambda cell: (cell // n_cols // side, cell % n_cols // side)
    (ay, ax), (by, bx) = square(src), square(dst)
    return np.where((src[at] == dst) & (dst != src), at, -1), (ay != by) | (ax != bx)


def _here(src: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of ``cells`` in sorted ``src``, whether they are there)."""
    at = np.searchsorted(src, cells)
    there = at < len(src)
    there[there] = src[at[there]] == cells[there]
    return at, there


def _gathered(following: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of ``own`` over each cell and all that drain to it, from the sources down."""
    total, open_in = own.copy(), np.bincount(following[following >= 0], minlength=len(own))
    front, seen = np.flatnonzero(open_in == 0), 0
    while len(front):
        seen += len(front)
        front = front[following[front] >= 0]
        to = following[front]
        np.add.at(total, to, total[front])
        np.subtract.at(open_in, to, 1)
        to = np.unique(to)
        front = to[open_in[to] == 0]
    if seen < len(own):
        raise ValueError("the flow has cycles")
    return total


def _ends(following: np.ndarray) -> np.ndarray:
    """The last cell of each cell's way through the tile; cells of a cycle end at one that goes on."""
    end = np.where(following >= 0, following, np.arange(len(following)))
    for _ in range(int(len(end)).bit_length()):
        end = end[end]
    return end


def accumulation(flow: DataFrame, n_cols: int, side: int = SIDE) -> DataFrame:
    """src, facc: the number of cells that drain through each cell of a grid, itself included. A cycle is an error.

    Cells that are not there hold and pass on nothing: flow to them ends.
    """

    def borders(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("src")
        src, dst = g["src"].to_numpy(np.int64), g["dst"].to_numpy(np.int64)
        following, out = _places(src, dst, n_cols, side)
        total, end = _gathered(following, np.ones(len(src), np.int64)), _ends(following)
        edge = np.flatnonzero(_border(src, n_cols, side))
        leaves = out[end[edge]]
        entered = pd.DataFrame({"node": src[edge], "ptr": pd.array(np.where(leaves, dst[end[edge]], 0), "Int64"), "acc": 0})
        entered.loc[~leaves, "ptr"] = pd.NA
        sent = pd.DataFrame({"node": dst[out], "ptr": pd.array([pd.NA] * int(out.sum()), "Int64"), "acc": total[out]})
        return pd.concat([entered, sent])

    def inner(group: pd.DataFrame) -> pd.DataFrame:
        g = group[group["dst"].notna()].sort_values("src")
        src, dst = g["src"].to_numpy(np.int64), g["dst"].to_numpy(np.int64)
        own, more = np.ones(len(src), np.int64), group[group["dst"].isna()]
        # What was sent to a cell that the grid lacks goes nowhere.
        at, there = _here(src, more["src"].to_numpy(np.int64))
        np.add.at(own, at[there], more["acc"].to_numpy(np.int64)[there])
        following = _places(src, dst, n_cols, side)[0] if len(src) else np.zeros(0, np.int64)
        return pd.DataFrame({"src": src, "facc": _gathered(following, own).astype(np.float64)})

    cells = flow.select("src", "dst")
    met = cut(cells.groupBy(*_tile(F.col("src"), n_cols, side)).applyInPandas(borders, "node long, ptr long, acc long"), "borders")
    # A border cell that is entered has something sent to it; the others are no nodes.
    nodes = met.groupBy("node").agg(F.max("ptr").alias("ptr"), F.sum("acc").alias("acc")).where("acc > 0")
    inflow = general.gathered(nodes)
    every = cells.withColumn("acc", F.lit(0).cast("long")).unionByName(inflow.select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), "acc"))
    return every.groupBy(*_tile(F.col("src"), n_cols, side)).applyInPandas(inner, "src long, facc double")


def labelled(flow: DataFrame, seeds: DataFrame, n_cols: int, side: int = SIDE) -> DataFrame:
    """node, label: that of the first seed on the way down; 0 for cells whose flow meets none.

    ``seeds``: node, label; of seeds at one cell the largest label holds. Cells of a cycle without
    a seed stay 0.
    """

    def solved(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """src, dst, end of each cell's way, whether it leaves the tile there, own or outer label of each cell (0 for none)."""
        g = group[group["dst"].notna()].sort_values("src")
        src, dst = g["src"].to_numpy(np.int64), g["dst"].to_numpy(np.int64)
        mark, seed = np.zeros(len(src), np.int64), group[group["dst"].isna()]
        np.maximum.at(mark, np.searchsorted(src, seed["src"].to_numpy(np.int64)), seed["label"].to_numpy(np.int64))
        following, out = _places(src, dst, n_cols, side)
        end = _ends(np.where(mark > 0, -1, following))
        return src, dst, end, out & (mark == 0), mark

    def borders(group: pd.DataFrame) -> pd.DataFrame:
        src, dst, end, out, mark = solved(group)
        edge = np.flatnonzero(_border(src, n_cols, side))
        at = end[edge]
        entered = pd.DataFrame({"node": src[edge], "ptr": np.where(out[at], dst[at], src[edge]), "label": mark[at], "exit": False})
        left = np.flatnonzero(out)
        return pd.concat([entered, pd.DataFrame({"node": src[left], "ptr": dst[left], "label": 0, "exit": True})])

    def inner(group: pd.DataFrame) -> pd.DataFrame:
        src, _, end, _, mark = solved(group)
        return pd.DataFrame({"node": src, "label": mark[end]})

    one = seeds.groupBy("node").agg(F.max("label").cast("long").alias("label")).select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), "label")
    cells = flow.select("src", "dst", F.lit(0).cast("long").alias("label"))
    # Seeds off the grid label nothing.
    every = cells.unionByName(one.join(cells.select("src"), "src", "left_semi").select("src", "dst", "label"))
    met = cut(every.groupBy(*_tile(F.col("src"), n_cols, side)).applyInPandas(borders, "node long, ptr long, label long, exit boolean"), "borders")
    entered = met.where("not exit")
    found = general.labelled(entered.select(F.col("node").alias("src"), F.col("ptr").alias("dst")), entered.where("label > 0").select("node", "label"))
    outer = met.where("exit").join(found.where("label > 0").withColumnRenamed("node", "ptr").withColumnRenamed("label", "got"), "ptr")
    brought = outer.select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("got").alias("label"))
    return every.unionByName(brought).groupBy(*_tile(F.col("src"), n_cols, side)).applyInPandas(inner, "node long, label long")


def path(flow: DataFrame, start: int, n_cols: int, side: int = SIDE) -> DataFrame:
    """node, step: the cells from ``start`` down to where its flow ends, or meets itself.

    Each tile tells where the flow that enters at a border cell leaves it, and after how many cells;
    the way through these is followed by doubling. Then only the tiles on it are read again, each
    with the cells where the way enters. A start off the grid gives no rows.
    """

    def hops(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("src")
        src, dst = g["src"].to_numpy(np.int64), g["dst"].to_numpy(np.int64)
        following, out = _places(src, dst, n_cols, side)
        end, steps = _ends(following), _steps(following)
        at = np.flatnonzero(_border(src, n_cols, side) | (src == start))
        at = at[out[end[at]]]
        return pd.DataFrame({"src": src[at], "dst": dst[end[at]], "n": steps[at] + 1})

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        cells = group[group["dst"].notna()]
        following = dict(zip(cells["src"].tolist(), cells["dst"].astype(np.int64).tolist()))
        rows = []
        for entry, first in group.loc[group["dst"].isna(), ["src", "first"]].astype(np.int64).itertuples(index=False):
            at, seen = entry, set()
            while at in following and at not in seen:
                rows.append((at, first + len(seen)))
                seen.add(at)
                at = following[at]
        return pd.DataFrame(rows, columns=["node", "step"])

    cells = flow.select("src", "dst")
    tile = _tile(F.col("src"), n_cols, side)
    jumps = cut(cells.groupBy(*tile).applyInPandas(hops, "src long, dst long, n long"), "hops")
    begin = cells.where(F.col("src") == start).select("src").distinct()
    way = general.path(jumps.select("src", "dst").unionByName(begin.join(jumps.select("src"), "src", "left_anti").withColumn("dst", F.col("src"))), start)
    # A row for each tile that the way crosses: numbered in one place.
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    entries = cut(way.join(jumps.select(F.col("src").alias("node"), "n"), "node", "left").select(F.col("node").alias("src"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first")), "entries")
    met = cells.select("src", "dst", F.lit(0).cast("long").alias("first"), *tile).join(entries.select(*tile).distinct(), ["ty", "tx"], "left_semi")
    marks = entries.select("src", F.lit(None).cast("long").alias("dst"), "first", *tile)
    found = met.unionByName(marks).groupBy("ty", "tx").applyInPandas(walk, "node long, step long")
    return found.groupBy("node").agg(F.min("step").alias("step"))


def _steps(following: np.ndarray) -> np.ndarray:
    """How many cells of the tile follow each one; of a cycle's cells, some number."""
    steps, ptr = (following >= 0).astype(np.int64), np.where(following >= 0, following, np.arange(len(following)))
    for _ in range(int(len(ptr)).bit_length()):
        steps = steps + steps[ptr]  # a last cell has none
        ptr = ptr[ptr]
    return steps
