"""Grids as one row for each cell: places, samples and areas."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0

#: Tasks that what lies in one square or band is dealt to.
SHARES = 8


@dataclass(frozen=True)
class GridMeta:
    """Georeference of a grid without rotation; ``px_h`` is negative where rows run south, ``crs`` is the number of its coordinate system, if known."""

    x0: float
    px_w: float
    y0: float
    px_h: float
    n_rows: int | None = None
    n_cols: int | None = None
    geographic: bool = False
    crs: int | None = None

    def column_of(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / F.lit(self.px_w))

    def row_of(self, y: Column) -> Column:
        return F.floor((y - F.lit(self.y0)) / F.lit(self.px_h))

    def x_of(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.px_w

    def y_of(self, row: Column) -> Column:
        return F.lit(self.y0) + (row + 0.5) * self.px_h

    def cell_area_m2(self) -> float:
        """Projected: the pixel's area. Geographic: metres for each degree at the latitude of the grid's first row."""
        if not self.geographic:
            return abs(self.px_w * self.px_h)
        lat = math.radians(self.y0 + self.px_h / 2)
        metre = math.pi / 180 * EARTH_RADIUS_M
        return abs(self.px_w * metre * math.cos(lat)) * abs(self.px_h * metre)


def without_nodata(cells: DataFrame, column: str, nodata: float | None) -> DataFrame:
    """NaN and the no-data value become null."""
    v = F.nanvl(F.col(column), F.lit(None).cast("double"))
    return cells.withColumn(column, v if nodata is None else F.when(v != nodata, v))


def window(cells: DataFrame, meta: GridMeta, x_min: float, x_max: float, y_min: float, y_max: float) -> DataFrame:
    """The cells of a bounding box; the ranges of rows and columns reach the scan as filters."""
    cols = sorted(math.floor((x - meta.x0) / meta.px_w) for x in (x_min, x_max))
    rows = sorted(math.floor((y - meta.y0) / meta.px_h) for y in (y_min, y_max))
    return cells.where(F.col("row_i").between(*rows) & F.col("col_i").between(*cols))


def sample(points: DataFrame, cells: DataFrame, meta: GridMeta, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the value of the cell they lie in; null outside the grid or where the cell has none."""
    at = points.withColumn("row_i", meta.row_of(F.col(y))).withColumn("col_i", meta.column_of(F.col(x)))
    return at.join(cells.select("row_i", "col_i", value), ["row_i", "col_i"], "left")


def shared(many: DataFrame, few: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(``many`` with a ``share`` by the columns ``by``, ``few`` with every share), to be joined by share besides squares or bands.

    A square that holds most of the one side is dealt to as many tasks. The other side is sized before
    it is expanded to squares: without the hint it might be broadcast.
    """
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))
    return many.withColumn("share", F.pmod(F.xxhash64(*by), F.lit(SHARES))), few.withColumn("share", every).hint("merge")


def point_in_rings(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """Points with the ``fid`` of each polygon that holds them, by the even-odd rule.

    Points and ring edges meet in horizontal bands of height ``cell``: an edge goes to the bands it
    crosses, so the join is an equi-join and a point meets only edges at its own height.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("fid", "part", "ring").orderBy("vidx")
    edges = rings.select("fid", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null and ay <> by")
    band = lambda y: F.floor(y / cell)
    banded = edges.withColumn("band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by")))))
    placed, bounds = shared(points.withColumn("band", band(F.col("y"))), banded, "x", "y")
    met = placed.join(bounds, ["band", "share"])
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (
        F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    )
    keys = [c for c in points.columns]
    return met.where(crosses).groupBy(*keys, "fid").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def ring_areas(rings: DataFrame) -> DataFrame:
    """fid, area_m2, area_km2: the shoelace formula; rings after the first of a part are holes."""
    from pyspark.sql import Window

    w = Window.partitionBy("fid", "part", "ring").orderBy("vidx")
    cross = F.col("x") * F.lead("y").over(w) - F.lead("x").over(w) * F.col("y")
    each = rings.select("fid", "part", "ring", cross.alias("c")).groupBy("fid", "part", "ring").agg(F.abs(F.sum("c") / 2).alias("a"))
    total = each.groupBy("fid").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area_m2"))
    return total.withColumn("area_km2", F.col("area_m2") / 1e6)


def first_of_each_shape(rings: DataFrame, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rings without repeated shapes, fid and reason of those left out): the smallest fid of equal rings stays."""
    shape = F.xxhash64(F.to_json(F.sort_array(F.collect_list(F.struct("part", "ring", "vidx", F.round("x", digits).alias("x"), F.round("y", digits).alias("y"))))))
    keyed = rings.groupBy("fid").agg(shape.alias("shape"))
    first = keyed.groupBy("shape").agg(F.min("fid").alias("keep"))
    judged = keyed.join(first.hint("merge"), "shape")  # a row for each polygon on both sides
    gone = judged.where("fid <> keep").select("fid", F.lit("duplicate geometry").alias("reason"))
    return rings.join(judged.where("fid = keep").select("fid").hint("merge"), "fid", "left_semi"), gone


def labels(features: DataFrame, column: str | None = None) -> DataFrame:
    """fid, label: the named column or the first of the usual names; null and blank labels become ``Basin_<fid>``."""
    usual = ("nom", "name", "id", "label", "bv", "basin", "watershed")
    if column is None:
        column = next((c for u in usual for c in features.columns if c.lower() == u), None)
    own = F.nullif(F.trim(F.col(column).cast("string")), F.lit("")) if column else F.lit(None).cast("string")
    return features.select("fid", F.coalesce(own, F.concat(F.lit("Basin_"), F.col("fid").cast("string"))).alias("label"))


def natural_key(label: str = "label") -> Column:
    """Sorts digits by their value: runs of digits are padded, letters lower-cased."""
    runs = F.regexp_extract_all(F.lower(F.col(label)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.concat_ws("", F.transform(runs, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)))
