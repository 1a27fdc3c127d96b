"""Connected parts of a grid and their sieve: parts of a tile are found in it, and only what touches across tiles is a graph.

The sieve works on the graph of parts that touch: a merge joins parts and adds up their sizes, and
the grid is read again only for the last labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import graphs
from .tiles import SIDE

_HALF = {False: [(0, 1), (1, 0)], True: [(0, 1), (1, 0), (1, 1), (1, -1)]}
#: A part's number is its first cell's: row, then column in 31 bits.
_COLUMN_BITS = 31


def unified(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component in a graph of ``n`` nodes."""
    top = np.arange(n)
    while True:
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        apart = low != high
        if not apart.any():
            return top
        a, b = a[apart], b[apart]
        np.minimum.at(top, high[apart], low[apart])
        while True:
            further = top[top]
            if (further == top).all():
                break
            top = further


def _key(row: Column, col: Column) -> Column:
    return F.shiftleft(row.cast("long"), _COLUMN_BITS) + col.cast("long")


def _in_tiles(labels: DataFrame, column: str, diagonal: bool, side: int) -> DataFrame:
    """row_i, col_i, v, part (within the tile), border, other: a row for each cell, and one without a cell for two parts of a tile that touch."""
    kind = labels.schema[column].dataType.simpleString()
    steps = _HALF[diagonal]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["row_i", "col_i"], ignore_index=True)
        r, c = g["row_i"].to_numpy(np.int64), g["col_i"].to_numpy(np.int64)
        y, x = r % side, c % side
        code = pd.factorize(g["v"])[0]
        number = np.full((side + 1, side + 2), -1)
        number[y, x + 1] = np.arange(len(g))
        pairs = []
        for dr, dc in steps:
            near = number[y + dr, x + 1 + dc]
            here = np.flatnonzero(near >= 0)
            pairs.append((here, near[here]))
        a, b = (np.concatenate(p) for p in zip(*pairs))
        same = (code[a] == code[b]) & (code[a] >= 0)
        top = unified(len(g), a[same], b[same])
        key = (r << _COLUMN_BITS) + c
        part = key[top]
        out = g[["row_i", "col_i", "v"]].copy()
        out["part"], out["border"], out["other"] = part, (y == 0) | (y == side - 1) | (x == 0) | (x == side - 1), pd.array([pd.NA] * len(g), "Int64")
        met = np.unique(np.stack([part[a[~same]], part[b[~same]]], axis=1), axis=0)
        touch = pd.DataFrame({"row_i": pd.array([pd.NA] * len(met), "Int64"), "col_i": pd.array([pd.NA] * len(met), "Int64"), "v": None, "part": met[:, 0], "border": False, "other": pd.array(met[:, 1], "Int64")})
        return pd.concat([out, touch.astype({"v": g["v"].dtype} if g["v"].dtype == object else {})], ignore_index=True) if len(met) else out

    dealt = labels.select("row_i", "col_i", F.col(column).alias("v"), F.floor(F.col("row_i") / side).alias("ty"), F.floor(F.col("col_i") / side).alias("tx"))
    return dealt.groupBy("ty", "tx").applyInPandas(solve, f"row_i long, col_i long, v {kind}, part long, border boolean, other long")


def _across(cells: DataFrame, diagonal: bool, side: int) -> DataFrame:
    """part, other, same: parts of two tiles that touch, and whether they are of one value."""
    square = lambda r, c: (F.floor(r / side), F.floor(c / side))
    at_border = cells.where("border").select("row_i", "col_i", "v", "part")
    step = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in _HALF[diagonal]]))
    each = at_border.withColumn("s", step).withColumns({"r2": F.col("row_i") + F.col("s.dr"), "c2": F.col("col_i") + F.col("s.dc")})
    (ay, ax), (by, bx) = square(F.col("row_i"), F.col("col_i")), square(F.col("r2"), F.col("c2"))
    each = each.where((ay != by) | (ax != bx)).select("r2", "c2", "v", "part")
    other = at_border.select(F.col("row_i").alias("r2"), F.col("col_i").alias("c2"), F.col("v").alias("w"), F.col("part").alias("other"))
    return each.join(other, ["r2", "c2"]).select("part", "other", F.coalesce(F.col("v") == F.col("w"), F.lit(False)).alias("same")).distinct()


def _solved(labels: DataFrame, column: str, diagonal: bool, side: int) -> tuple[DataFrame, DataFrame]:
    """(row_i, col_i, v, part over the grid; part and other of all pairs of parts that touch)."""
    tiled = cut(_in_tiles(labels, column, diagonal, side), "tiled")
    cells = tiled.where("other is null")
    across = cut(_across(cells, diagonal, side), "across")
    root = graphs.components(across.where("same").select(F.col("part").alias("a"), F.col("other").alias("b")))
    whole = lambda d, c: d.join(root.withColumnsRenamed({"node": c, "root": "r_"}), c, "left").withColumn(c, F.coalesce("r_", c)).drop("r_")
    touching = tiled.where("other is not null").select("part", "other").unionByName(across.where("not same").select("part", "other"))
    touching = whole(whole(touching, "part"), "other").where("part <> other").distinct()
    return whole(cells.select("row_i", "col_i", "v", "part"), "part"), touching


def parts(labels: DataFrame, column: str = "cluster", diagonal: bool = False, side: int = SIDE) -> DataFrame:
    """row_i, col_i, ``column``, part: connected cells of one value; a part's number is the key of its first cell.

    A cell whose value is null is a part of its own.
    """
    return _solved(labels, column, diagonal, side)[0].select("row_i", "col_i", F.col("v").alias(column), "part")


def sieved(labels: DataFrame, least: int, column: str = "cluster", rounds: int = 1000, side: int = SIDE) -> DataFrame:
    """Labels with parts (8-connected) under ``least`` cells merged into the largest part beside them.

    All small parts that have a larger neighbour (of equals the smaller number) merge in a round;
    rounds go on until none is left or what is left touches nothing larger.
    """
    cells, touching = _solved(labels, column, True, side)
    cells = cut(cells, "cells")
    beside = touching.select("part", "other").unionByName(touching.select(F.col("other").alias("part"), F.col("part").alias("other")))
    beside = cut(beside.distinct(), "beside")
    sizes = cut(cells.groupBy("part").agg(F.count("*").alias("n"), F.first("v").alias("v")), "sizes")
    found = cut(sizes.select(F.col("part").alias("own"), "part"), "merged")
    for _ in range(rounds):
        small = sizes.where(F.col("n") < least)
        named = sizes.select(F.col("part").alias("other"), F.col("n").alias("m"), F.col("v").alias("to"))
        larger = beside.join(small.select("part", "n"), "part").join(named, "other").where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("part"))))
        best = cut(larger.groupBy("part").agg(F.max_by("to", F.struct("m", -F.col("other"))).alias("to"), F.lit(True).alias("moved")), "merge")
        if best.isEmpty():
            last = sizes.select("part", "v")
            return cells.select("row_i", "col_i", F.col("part").alias("own")).join(found, "own").join(last, "part").select("row_i", "col_i", F.col("v").alias(column))
        valued = cut(sizes.join(best, "part", "left").select("part", "n", F.when(F.col("moved"), F.col("to")).otherwise(F.col("v")).alias("v")), "valued")
        ends = beside.join(valued.select("part", "v"), "part").join(valued.select(F.col("part").alias("other"), F.col("v").alias("w")), "other")
        root = graphs.components(ends.where("v = w").select(F.col("part").alias("a"), F.col("other").alias("b")))
        to = root.select(F.col("node").alias("part"), F.col("root").alias("top"))
        sizes = cut(valued.join(to, "part", "left").groupBy(F.coalesce("top", "part").alias("part")).agg(F.sum("n").alias("n"), F.first("v").alias("v")), "sizes")
        found = cut(found.join(to, "part", "left").select("own", F.coalesce("top", "part").alias("part")), "merged")
        moved = beside.join(to, "part", "left").join(to.withColumnsRenamed({"part": "other", "top": "ot"}), "other", "left")
        beside = cut(moved.select(F.coalesce("top", "part").alias("part"), F.coalesce("ot", "other").alias("other")).where("part <> other").distinct(), "beside")
    raise RuntimeError(f"the sieve did not settle in {rounds} rounds")
