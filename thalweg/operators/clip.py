"""Lines and cells cut to polygons of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid, zones


def _tiles(lo: str, hi: str, cell: float):
    return F.sequence(F.floor(F.least(lo, hi) / cell), F.floor(F.greatest(lo, hi) / cell))


def lines_in_polygons(vertices: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """fid (of the polygon), line, vidx, piece, x1, y1, x2, y2: the stretches of lines inside polygons, in line order.

    A line's segments meet the polygon edges in the squares of size ``cell`` that both touch and are
    split where they cross; a stretch is inside if its middle is, by the even-odd rule. A polygon
    and a segment that share no square with an edge are settled by the segment's middle alone.
    """
    w = Window.partitionBy("fid").orderBy("vidx")
    segs = vertices.select(F.col("fid").alias("line"), "vidx", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    r = Window.partitionBy("fid", "part", "ring").orderBy("vidx")
    edges = rings.select("fid", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(r).alias("bx"), F.lead("y").over(r).alias("by")).where("bx is not null")
    tiled = lambda df, x0, x1, y0, y1: df.withColumn("tx", F.explode(_tiles(x0, x1, cell))).withColumn("ty", F.explode(_tiles(y0, y1, cell)))
    near, bounds = grid.shared(tiled(segs, "x1", "x2", "y1", "y2"), tiled(edges, "ax", "bx", "ay", "by"), "line", "vidx")
    met = near.join(bounds, ["tx", "ty", "share"])
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    turn = dx * ey - dy * ex
    t = F.try_divide((F.col("ax") - F.col("x1")) * ey - (F.col("ay") - F.col("y1")) * ex, turn)
    u = F.try_divide((F.col("ax") - F.col("x1")) * dy - (F.col("ay") - F.col("y1")) * dx, turn)
    cuts = met.withColumn("t", t).withColumn("u", u).where("t > 0 and t < 1 and u >= 0 and u <= 1").groupBy("line", "vidx").agg(F.collect_set("t").alias("ts"))
    split = segs.join(cuts.hint("merge"), ["line", "vidx"], "left")
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>")))))
    spans = F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda i: F.struct(F.get("stops", i).alias("t0"), F.get("stops", i + 1).alias("t1")))
    pieces = split.withColumn("stops", stops).select("line", "vidx", "x1", "y1", "x2", "y2", F.posexplode(spans).alias("piece", "s"))
    on = lambda p, q, k: F.col(p) + k * (F.col(q) - F.col(p))
    cut = pieces.select(
        "line", "vidx", "piece", on("x1", "x2", F.col("s.t0")).alias("x1"), on("y1", "y2", F.col("s.t0")).alias("y1"), on("x1", "x2", F.col("s.t1")).alias("x2"), on("y1", "y2", F.col("s.t1")).alias("y2"),
        on("x1", "x2", (F.col("s.t0") + F.col("s.t1")) / 2).alias("x"), on("y1", "y2", (F.col("s.t0") + F.col("s.t1")) / 2).alias("y"),
    )
    return grid.point_in_rings(cut, rings, cell).select("fid", "line", "vidx", "piece", "x1", "y1", "x2", "y2")


def parts(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, vertices) of the connected stretches of each line in each polygon.

    segments: basin_id, seg_id, start_x, start_y, end_x, end_y, len_m; vertices: basin_id, seg_id,
    vidx, x, y. seg_id counts from 0 within a polygon, by line and place.
    """
    w = Window.partitionBy("fid", "line").orderBy("vidx", "piece")
    breaks = (F.lag("x2").over(w) != F.col("x1")) | (F.lag("y2").over(w) != F.col("y1"))
    # An end computed from either side may differ in the last bits: stretches in a row of one segment share it.
    near = (F.abs(F.lag("x2").over(w) - F.col("x1")) < 1e-9) & (F.abs(F.lag("y2").over(w) - F.col("y1")) < 1e-9)
    marked = pieces.withColumn("new", F.when(F.coalesce(breaks & ~near, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("part", F.sum("new").over(w))
    ids = Window.partitionBy("fid").orderBy("line", "part")
    each = numbered.withColumn("seg_id", (F.dense_rank().over(ids) - 1).cast("long")).withColumnRenamed("fid", "basin_id")
    order = F.struct("vidx", "piece")
    segments = each.groupBy("basin_id", "seg_id").agg(
        F.min_by("x1", order).alias("start_x"), F.min_by("y1", order).alias("start_y"), F.max_by("x2", order).alias("end_x"), F.max_by("y2", order).alias("end_y"),
        F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("len_m"),
    )
    within = Window.partitionBy("basin_id", "seg_id").orderBy("vidx", "piece")
    place = each.withColumn("k", (F.row_number().over(within)).cast("long"))
    tail = place.select("basin_id", "seg_id", F.col("k").alias("vidx"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    head = place.where("k = 1").select("basin_id", "seg_id", F.lit(0).cast("long").alias("vidx"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return segments, head.unionByName(tail)


def cells_in_mask(cells: DataFrame, rings: DataFrame, meta: grid.GridMeta) -> DataFrame:
    """The cells whose centres lie in a polygon, each once. Not broadcast: see ``zones.cells_in_zones``."""
    return cells.join(zones.members(rings, meta).select("row_i", "col_i").hint("merge"), ["row_i", "col_i"], "left_semi")
