"""Cells within polygons by scanlines: a ring crosses a row of cell centres at known places, and between the first and the second lies what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid


def crossings(rings: DataFrame, meta: grid.GridMeta) -> DataFrame:
    """fid, row_i, x: where the rings (fid, part, ring, vidx, x, y) cross the rows' centres, holes' rings too.

    A row is crossed by the edges of which one end lies above its centre and the other not.
    """
    w = Window.partitionBy("fid", "part", "ring").orderBy("vidx")
    ends = rings.select("fid", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    edges = ends.where("bx is not null and ay <> by")
    row = [meta.row_of(F.col(c)) for c in ("ay", "by")]
    low, high = F.least(*row) - 1, F.greatest(*row) + 1
    # Rows beyond the grid hold no cells.
    low = F.greatest(low, F.lit(0))
    if meta.n_rows is not None:
        high = F.least(high, F.lit(meta.n_rows - 1))
    each = edges.where(low <= high).withColumn("row_i", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    y = meta.y_of(F.col("row_i"))
    met = each.where((F.col("ay") > y) != (F.col("by") > y))
    return met.select("fid", "row_i", ((F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("x"))


def spans(rings: DataFrame, meta: grid.GridMeta) -> DataFrame:
    """fid, row_i, low, high: the stretches of a row inside each polygon by the even-odd rule, from ``low`` on and short of ``high``."""
    w = Window.partitionBy("fid", "row_i").orderBy("x")
    paired = crossings(rings, meta).withColumn("k", F.row_number().over(w)).withColumn("high", F.lead("x").over(w))
    return paired.where("k % 2 = 1 and high is not null and x < high").select("fid", "row_i", F.col("x").alias("low"), "high")


def members(rings: DataFrame, meta: grid.GridMeta) -> DataFrame:
    """fid, row_i, col_i: the cells of the grid whose centres lie in each polygon. As many rows as there are such cells."""
    column = [meta.column_of(F.col(c)) for c in ("low", "high")]
    first, last = F.least(*column) - 1, F.greatest(*column) + 1
    if meta.n_cols is not None:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(meta.n_cols - 1))
    each = spans(rings, meta).where(first <= last).withColumn("col_i", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    x = meta.x_of(F.col("col_i"))
    return each.where((x >= F.col("low")) & (x < F.col("high"))).select("fid", "row_i", "col_i")


def cells_in_zones(cells: DataFrame, rings: DataFrame, meta: grid.GridMeta) -> DataFrame:
    """``cells`` (row_i, col_i, ...) with the ``fid`` of each polygon that holds their centre: an equi-join, with nothing to test after it.

    The cells of a polygon are sized by its few corners before they are expanded: without the hint they would be broadcast.
    """
    return cells.join(members(rings, meta).hint("merge"), ["row_i", "col_i"])
