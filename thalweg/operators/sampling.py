"""Rivers and stream ends sampled on grids: the profiles that channel and steepness metrics start from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid, polylines, series

#: Points with an elevation that a river needs.
LEAST_POINTS = 5
#: Steps of a walk that a task holds, unless a single river has more.
STEPS_A_TASK = 500_000


def _lookup(points: DataFrame, cells: DataFrame, meta: grid.GridMeta, value: str, out: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points with ``out``, the value of the cell at (x, y); null outside the grid, and where it is NaN."""
    found = grid.sample(points, cells, meta, value, x, y).drop("row_i", "col_i")
    return found.withColumn(out, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).drop(*([] if out == value else [value]))


def ends(segments: DataFrame, dem: DataFrame, meta: grid.GridMeta, value: str = "z") -> DataFrame:
    """Segments (start_x, start_y, end_x, end_y) with z_start and z_end; null where the grid has no value."""
    return _lookup(_lookup(segments, dem, meta, value, "z_start", "start_x", "start_y"), dem, meta, value, "z_end", "end_x", "end_y")


def _kept(points: DataFrame, order: str, least: int) -> DataFrame:
    """Points with an elevation, numbered anew along each river; rivers with too few are left out."""
    known = points.where("elev is not null")
    many = F.count("*").over(Window.partitionBy("basin_id"))
    idx = (F.row_number().over(Window.partitionBy("basin_id").orderBy(order)) - 1).cast("long")
    return known.withColumn("idx", idx).withColumn("n_", many).where(F.col("n_") >= least).drop("n_")


def equidistant(rivers: DataFrame, dem: DataFrame, meta: grid.GridMeta, n: int = 200, value: str = "z", least: int = LEAST_POINTS) -> DataFrame:
    """basin_id, idx, dist_m, elev, x, y: ``n`` places equally spaced along each river (fid, vidx, x, y).

    Places without an elevation go; a river without length, or with fewer than ``least`` places
    left, has no rows.
    """
    spots = polylines.stations(rivers, n).withColumnsRenamed({"fid": "basin_id", "dist": "dist_m"})
    found = _kept(_lookup(spots, dem, meta, value, "elev"), "station", least)
    return found.select("basin_id", "idx", "dist_m", "elev", "x", "y")


def _drained(points: DataFrame, facc: DataFrame, meta: grid.GridMeta, order: str, cell_m2: Column) -> DataFrame:
    """Points with area_m2 (gaps filled along the river, a cell's area where it is not positive) and fac_valid: half of the points or more had a value."""
    found = _lookup(points, facc, meta, "facc", "facc_").withColumn("raw_", F.col("facc_") * cell_m2).withColumn("cell_", cell_m2)
    share = F.count("raw_").over(Window.partitionBy("basin_id")) >= F.count("*").over(Window.partitionBy("basin_id")) * 0.5
    w = Window.partitionBy("basin_id").orderBy(order)
    before = F.last("raw_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("raw_", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    filled = found.withColumn("fac_valid", share).withColumn("area_m2", F.coalesce(before, after))
    return filled.withColumn("area_m2", F.when(F.col("area_m2") > 0, F.col("area_m2")).otherwise(F.col("cell_"))).drop("facc_", "raw_", "cell_")


def cell_metres(meta: grid.GridMeta) -> float:
    """A cell's width in metres: as it is, or at the latitude of the grid's first row."""
    return abs(meta.px_w) if not meta.geographic else abs(meta.cell_area_m2() / meta.px_h / (grid.EARTH_RADIUS_M * 3.141592653589793 / 180))


def hydraulic(rivers: DataFrame, dem: DataFrame, facc: DataFrame, meta: grid.GridMeta, n: int = 200, value: str = "z") -> DataFrame:
    """Equidistant places with the drained area, its validity and the slope as well: basin_id, idx, dist_m, elev, area_m2, slope, fac_valid."""
    base = equidistant(rivers, dem, meta, n, value)
    full = _drained(base, facc, meta, "idx", F.lit(cell_metres(meta) ** 2))
    return series.slope(full).select("basin_id", "idx", "dist_m", "elev", "area_m2", "slope", "fac_valid")


def _on_grid(cells: DataFrame, meta: grid.GridMeta) -> DataFrame:
    """Only the cells that are met: the rest of a larger grid would keep Spark from broadcasting them, and steps of all rivers would go to a few cells' tasks."""
    return cells.where(F.col("row_i").between(0, meta.n_rows - 1) & F.col("col_i").between(0, meta.n_cols - 1))


def _steps(rivers: DataFrame, dem: DataFrame, meta: grid.GridMeta, value: str, least: int) -> DataFrame:
    """basin_id, step_, x, y, dist_m, elev of the steps of rivers with ``least`` of them on the grid."""
    # Vertices become many times as many steps: tasks are dealt by these, which Spark does not see before.
    tasks = max(rivers.sparkSession.sparkContext.defaultParallelism, math.ceil(polylines.step_count(rivers, cell_metres(meta)) / STEPS_A_TASK))
    steps = polylines.walked(rivers.repartition(tasks, "fid"), cell_metres(meta)).withColumnRenamed("fid", "basin_id")
    row, col = meta.row_of(F.col("y")), meta.column_of(F.col("x"))
    inside = steps.where(row.between(0, meta.n_rows - 1) & col.between(0, meta.n_cols - 1))
    w = Window.partitionBy("basin_id").orderBy("idx")
    chord = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    far = inside.withColumn("d_", chord).withColumn("dist_m", F.sum("d_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("d_").withColumnRenamed("idx", "step_")
    long = far.withColumn("n_", F.count("*").over(Window.partitionBy("basin_id"))).where(F.col("n_") >= least).drop("n_")
    return _lookup(long, _on_grid(dem, meta), meta, value, "elev")


def reached(rivers: DataFrame, dem: DataFrame, meta: grid.GridMeta, value: str = "z", least: int = LEAST_POINTS) -> DataFrame:
    """basin_id of the rivers that ``cell_by_cell`` has rows of: elevations alone decide."""
    return _steps(rivers, dem, meta, value, least).groupBy("basin_id").agg(F.count("elev").alias("n_")).where(F.col("n_") >= least).select("basin_id")


def cell_by_cell(rivers: DataFrame, dem: DataFrame, facc: DataFrame, meta: grid.GridMeta, value: str = "z", least: int = LEAST_POINTS) -> DataFrame:
    """basin_id, idx, dist_m, elev, area_m2, slope, fac_valid of every step of 0.3 cells along each river.

    Steps off the grid (``meta`` with n_rows and n_cols) go; distances are chords between the steps that
    stay; steps without an elevation go afterwards.
    """
    full = _kept(_drained(_steps(rivers, dem, meta, value, least), _on_grid(facc, meta), meta, "step_", F.lit(cell_metres(meta) ** 2)), "step_", least)
    # idx goes up with step_, in whose order the rows are already.
    return series.slope(full, order="step_").select("basin_id", "idx", "dist_m", "elev", "area_m2", "slope", "fac_valid")


def first_source(*sources: DataFrame | None) -> DataFrame | None:
    """The first accumulation grid that is there and has a value: a user's own, one kept, one computed."""
    return next((s for s in sources if s is not None and not s.where("facc is not null").isEmpty()), None)


def place_at(vertices: DataFrame, distances: DataFrame) -> DataFrame:
    """fid, dist, x, y: where ``dist`` (fid, dist) lies on each line; beyond an end there is no place."""
    w = Window.partitionBy("fid").orderBy("vidx")
    spans = polylines.measured(vertices).select("fid", "x", "y", "cum", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.lag("cum").over(w).alias("pcum"))
    # A vertex belongs to the stretch that ends there; the start to the first stretch.
    met = distances.join(spans.where("cum > pcum"), "fid").where("dist <= cum and (dist > pcum or (dist = 0 and pcum = 0))")
    t = (F.col("dist") - F.col("pcum")) / (F.col("cum") - F.col("pcum"))
    return met.select("fid", "dist", (F.col("px") + t * (F.col("x") - F.col("px"))).alias("x"), (F.col("py") + t * (F.col("y") - F.col("py"))).alias("y"))
