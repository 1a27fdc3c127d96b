"""Whole tools: rasters, basins and streams in; profiles, metrics, map units and what was left out, out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import channel, checks, clip, filling, flow, fluvial, geodesy, grid, hypsometry, mapunits, network, outlets, outlines, polylines, sampling, series, tables, tiles, zones
from . import parts as grouping
from . import swath as swaths

#: Message of a tool that was given no accumulation.
COMPUTED = "accumulation computed from the elevations"


@dataclass
class Rivers:
    """vertices: fid, vidx, x, y from source to mouth; lengths: basin_id, length_m, n_segments; skipped: fid, reason."""

    vertices: DataFrame
    lengths: DataFrame
    skipped: DataFrame


def on_grid(features: DataFrame, crs: int | None, meta: grid.GridMeta) -> DataFrame:
    """Features (x, y) of another coordinate system in that of the grid; unchanged where either is not named."""
    return features if crs is None or meta.crs is None else geodesy.reprojected(features, crs, meta.crs)


def main_rivers(streams: DataFrame, basins: DataFrame, dem: DataFrame, meta: grid.GridMeta, snap: float = 2.0, cell: float = 1000.0, value: str = "z", crs: int | None = None) -> Rivers:
    """The main river of each basin (rings) from streams (fid, vidx, x, y): clipped, turned downhill, snapped, weighed and traced.

    Rings that cross or overlap are repaired; basins with other faults, and basins without a stream,
    are skipped with a reason. ``crs`` is the system of streams and basins, where it is not the grid's.
    """
    streams, basins = on_grid(streams, crs, meta), on_grid(basins, crs, meta)
    sound, faults = checks.usable(basins, cell)
    pieces = cut(clip.lines_in_polygons(streams, sound, cell), "pieces")
    segments, vertices = clip.parts(pieces)
    turned = cut(network.downhill(sampling.ends(segments, dem, meta, value)), "segments")
    river = cut(network.place_river(*network.places(turned, snap)), "river")
    key = ["basin_id", "seg_id"]
    # Rivers are few of the segments; these are sized by a byte or so a number, and without the hint might be broadcast.
    placed = vertices.join(river.select(*key, "place"), key).join(turned.select(*key, "turned").hint("merge"), key)
    last = F.max("vidx").over(Window.partitionBy(*key))
    down = placed.withColumn("k", F.when(F.col("turned"), last - F.col("vidx")).otherwise(F.col("vidx"))).withColumn("n", last)
    # An upstream segment's lower end is where the next one starts, as near as snapping allows.
    joined = down.where("place = 0 or k < n")
    order = Window.partitionBy("basin_id").orderBy(F.desc("place"), "k")
    line = joined.select(F.col("basin_id").alias("fid"), (F.row_number().over(order) - 1).cast("long").alias("vidx"), "x", "y")
    counts = turned.groupBy("basin_id").agg(F.count("*").alias("n_segments"))
    lengths = river.groupBy("basin_id").agg(F.max("length_m").alias("length_m")).join(counts, "basin_id")
    none = network.without_stream(sound.select("fid").distinct(), pieces)
    return Rivers(cut(line, "rivers"), lengths, faults.unionByName(none))


@dataclass
class Channels:
    points: DataFrame
    metrics: DataFrame
    counts: DataFrame  # basin_id, n_points
    skipped: DataFrame


def channels(rivers: DataFrame, dem: DataFrame, meta: grid.GridMeta, n: int = 200, smooth: int = 0, value: str = "z") -> Channels:
    """Normalised profiles and their metrics of rivers (fid, vidx, x, y) over a grid."""
    profile = sampling.equidistant(rivers, dem, meta, n, value).select("basin_id", "idx", "dist_m", "elev")
    if smooth >= 3:
        profile = series.smoothed(profile, "elev", smooth).withColumn("elev", F.col("smooth")).drop("smooth")
    whole = cut(series.high_to_low(profile).drop("turn"), "profiles")
    points = channel.normalised(whole)
    none = rivers.select(F.col("fid").alias("basin_id")).distinct().join(whole.select("basin_id").distinct(), "basin_id", "left_anti")
    skipped = none.withColumn("reason", F.lit("too few points with an elevation")).unionByName(channel.skipped(whole))
    return Channels(points, channel.metrics(points), whole.groupBy("basin_id").agg(F.count("*").alias("n_points")), skipped)


class Fluvial:
    """The fluvial tool's tables. Each is made when it is first read: which rivers are skipped takes elevations only, no accumulation and no knickpoints."""

    def __init__(self, rivers: DataFrame, dem: DataFrame, facc: Callable[[], DataFrame], meta: grid.GridMeta, theta: float, a0: float, depth: int, smooth: int, method: str, value: str):
        self._rivers, self._dem, self._facc, self._meta, self._value = rivers, dem, facc, meta, value
        self._theta, self._a0, self._depth, self._smooth, self._method = theta, a0, depth, smooth, method

    @cached_property
    def profile(self) -> DataFrame:
        base = sampling.cell_by_cell(self._rivers, self._dem, self._facc(), self._meta, self._value).select("basin_id", "idx", "dist_m", "elev", "area_m2")
        return cut(fluvial.analysed(base, self._theta, self._a0, self._smooth), "analysed")

    @cached_property
    def knickpoints(self) -> DataFrame:
        return cut(fluvial.knickpoints(self.profile, self._depth), "knickpoints")

    @cached_property
    def segments(self) -> DataFrame:
        return fluvial.segments(self.profile, self.knickpoints.select("basin_id", "idx"), self._method, self._theta)

    @cached_property
    def summary(self) -> DataFrame:
        return fluvial.summary(self.profile)

    @property
    def skipped(self) -> DataFrame:
        """basin_id, reason; from the profile where that is there already."""
        reached = self.profile.select("basin_id").distinct() if "profile" in self.__dict__ else sampling.reached(self._rivers, self._dem, self._meta, self._value)
        every = self._rivers.select(F.col("fid").alias("basin_id")).distinct()
        return every.join(reached, "basin_id", "left_anti").withColumn("reason", F.lit("too few points with an elevation"))


def steepness(rivers: DataFrame, dem: DataFrame, facc: DataFrame | Callable[[], DataFrame], meta: grid.GridMeta, theta: float = 0.45, a0: float = 1.0, depth: int = 3, smooth: int = 0, method: str = "chi_slope", value: str = "z") -> Fluvial:
    """Every metric of the fluvial tool along rivers (fid, vidx, x, y), sampled cell by cell; rivers with too few points are skipped with a reason.

    ``facc`` may be a function that gives the accumulation: it is called when a table that needs it is read.
    """
    return Fluvial(rivers, dem, facc if callable(facc) else lambda: facc, meta, theta, a0, depth, smooth, method, value)


def accumulation_of(facc: DataFrame | None, dem: DataFrame, meta: grid.GridMeta, value: str = "z") -> tuple[DataFrame, str | None]:
    """(src, row_i, col_i, facc; a message where it was computed): a user's own accumulation if it has a value, else that of the elevations.

    Depressions are filled and flats drained before (``filling.flow``); cells without an elevation have no accumulation.
    """
    own = sampling.first_source(facc)
    if own is not None:
        return own.withColumn("src", F.col("row_i") * meta.n_cols + F.col("col_i")).select("src", "row_i", "col_i", "facc"), None
    numbered = dem.withColumn("src", F.col("row_i") * meta.n_cols + F.col("col_i"))
    down = cut(filling.flow(numbered, meta.n_cols, (meta.px_w, meta.px_h), value=value).select("src", "dst"), "flow")
    found = cut(tiles.accumulation(down, meta.n_cols), "facc")
    return found.select("src", F.floor(F.col("src") / meta.n_cols).alias("row_i"), (F.col("src") % meta.n_cols).alias("col_i"), "facc"), COMPUTED


@dataclass
class Report:
    """What a whole tool gives: its parts, labels (fid, label), what was skipped (fid, label, reason) and messages."""

    rivers: Rivers
    found: Channels | Fluvial
    labels: DataFrame
    messages: list[str]

    @property
    def skipped(self) -> DataFrame:
        return _whole_skipped(self.rivers, self.found, self.labels)


def _whole_skipped(rivers: Rivers, found: Channels | Fluvial, labels: DataFrame) -> DataFrame:
    """fid, label, reason of every basin that gives no result, from clipping to sampling."""
    late = found.skipped.select(F.col("basin_id").alias("fid"), "reason")
    return rivers.skipped.unionByName(late).join(labels, "fid", "left").select("fid", F.coalesce("label", F.concat(F.lit("Basin_"), F.col("fid").cast("string"))).alias("label"), "reason")


def ncp_of(streams: DataFrame, basins: DataFrame, dem: DataFrame, meta: grid.GridMeta, n: int = 200, smooth: int = 0, label: str | None = None, snap: float = 2.0, cell: float = 1000.0) -> Report:
    """Normalised channel profiles of the main river of each basin, from streams (fid, vidx, x, y), basins (rings) and elevations."""
    names = grid.labels(basins.dropDuplicates(["fid"]), label)
    rivers = main_rivers(streams, basins, dem, meta, snap, cell)
    found = channels(rivers.vertices, dem, meta, n, smooth)
    return Report(rivers, found, names, [])


def fluvial_of(streams: DataFrame, basins: DataFrame, dem: DataFrame, meta: grid.GridMeta, facc: DataFrame | None = None, theta: float = 0.45, a0: float = 1.0, depth: int = 3, smooth: int = 0, label: str | None = None, snap: float = 2.0, cell: float = 1000.0) -> Report:
    """The fluvial tool on the main river of each basin; without an accumulation it is computed from the elevations."""
    names = grid.labels(basins.dropDuplicates(["fid"]), label)
    rivers = main_rivers(streams, basins, dem, meta, snap, cell)
    message = None if sampling.first_source(facc) is not None else COMPUTED
    found = steepness(rivers.vertices, dem, lambda: accumulation_of(facc, dem, meta)[0], meta, theta, a0, depth, smooth)
    return Report(rivers, found, names, [message] if message else [])


def hypsometry_of(dem: DataFrame, basins: DataFrame, meta: grid.GridMeta, label: str | None = None, n_points: int = 200, least_cells: int = 10, cell: float = 1000.0, crs: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, curves, skipped) of basins (rings, with any label column) over a grid of z.

    results: basin_id, label, hi, stage, area_km2, z_min, z_max, relief, n_cells; areas are
    ellipsoidal on a geographic grid. Rings that cross or overlap are repaired; other faulty
    polygons, repeated ones and basins with too few cells are skipped with a reason. ``crs`` is the
    system of the basins, where it is not the grid's.
    """
    basins = on_grid(basins, crs, meta)
    sound, faults = checks.usable(basins, cell)
    names = grid.labels(basins.dropDuplicates(["fid"]), label).withColumnRenamed("fid", "basin_id")
    once, repeated = grid.first_of_each_shape(sound)
    cells = cut(zones.cells_in_zones(dem.select("row_i", "col_i", "z"), once, meta).select(F.col("fid").alias("basin_id"), "z"), "zones")
    curves = cut(hypsometry.curve(cells, n_points, least_cells), "curves")
    hi = hypsometry.integral(curves)
    area = (geodesy if meta.geographic else grid).ring_areas(once).select(F.col("fid").alias("basin_id"), F.round("area_km2", 4).alias("area_km2"))
    # A row for each polygon on every side: with the hints none is sent to the driver.
    found = hypsometry.summary(cells, least_cells)
    for each in (hi, area, names):
        found = found.join(each.hint("merge"), "basin_id")
    found = found.withColumn("stage", hypsometry.stage(F.col("hi")))
    empty = once.select("fid").distinct().join(cells.select(F.col("basin_id").alias("fid")).distinct().hint("merge"), "fid", "left_anti").withColumn("reason", F.lit("no cell in polygon"))
    few = hypsometry.skipped(cells, least_cells).withColumnRenamed("basin_id", "fid")
    return found, curves, faults.unionByName(repeated).unionByName(empty).unionByName(few)


def swath_of(lines: DataFrame, dem: DataFrame, meta: grid.GridMeta, n_stations: int = 200, width: float = 1000.0, n_transversal: int = 50, high_to_low: bool = False, smooth: int = 0, quartiles: bool = False, first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stations, ticks) of swaths along lines: statistics with dist, turned and smoothed as asked for, and tick intervals.

    ``width`` is the whole width. ``first_only`` keeps the line of the smallest fid.
    """
    if first_only:
        lines, _ = checks.first_feature(lines)
    spots = polylines.stations(lines, n_stations).select("fid", "station", "dist")
    # Two readings of one line may differ in nothing but order: the join is by place.
    found = swaths.profile(lines, dem, meta, n_stations, width / 2, n_transversal, quartiles).join(spots, ["fid", "station"])
    columns = [c for c in found.columns if c not in ("fid", "station", "n", "dist")]
    named = found.withColumnsRenamed({"fid": "basin_id", "station": "idx"})
    if high_to_low:
        named = series.high_to_low(named, "mean", "dist").drop("turn")
    if smooth >= 3:
        for c in columns:
            named = series.smoothed(named, c, smooth).withColumn(c, F.col("smooth")).drop("smooth")
    out = named.withColumnsRenamed({"basin_id": "fid", "idx": "station"})
    # Where no station has a mean there is no range to divide.
    z_tick = F.when(F.count("mean") > 0, swaths.nice_interval((F.max("mean") - F.min("mean")) / 6)).otherwise(F.lit(100.0))
    ticks = out.groupBy("fid").agg(swaths.nice_interval(F.max("dist") / 8).alias("x_tick"), z_tick.alias("z_tick"))
    return out, ticks


def polygons(labels: DataFrame, meta: grid.GridMeta, column: str = "label", holes: bool = True) -> DataFrame:
    """``column``, part, ring, vidx, x, y: outlines of areas of one label as rings in world coordinates.

    Cells that touch by a side are one part. Of a part the ring with the largest extent is its outside (ring 0); without ``holes`` only that stays.
    """
    parts = cut(grouping.parts(labels.select("row_i", "col_i", column), column), "parts")
    traced = cut(outlines.rings(parts.select("row_i", "col_i", F.col("part").alias("label")), meta.n_cols), "rings")
    names = parts.groupBy("part").agg(F.first(column).alias(column))
    at = traced.select(F.col("label").alias("part"), "ring", "vidx", (F.lit(meta.x0) + F.col("c") * meta.px_w).alias("x"), (F.lit(meta.y0) + F.col("r") * meta.px_h).alias("y"))
    box = at.groupBy("part", "ring").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("extent"))
    order = Window.partitionBy("part").orderBy(F.desc("extent"), "ring")
    ranked = box.withColumn("place", (F.row_number().over(order) - 1).cast("int")).select("part", "ring", "place")
    kept = ranked if holes else ranked.where("place = 0")
    return at.join(kept, ["part", "ring"]).join(names, "part").select(column, "part", F.col("place").alias("ring"), "vidx", "x", "y")


def map_units(pixels: DataFrame, meta: grid.GridMeta, k: int = 8, smooth: int = 5, sieve: int = 5000, mask: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outlines cluster_id, part, ring, vidx, x, y; colours cluster, r, g, b) of an image clustered by colour.

    Pixels are clustered, smoothed by a median, sieved and outlined; with ``mask`` (rings) only cells
    whose centres lie in it are outlined.
    """
    labels, centres = mapunits.kmeans(pixels, k, meta.n_cols)
    cleaned = mapunits.median(labels, meta.n_rows, meta.n_cols, smooth) if smooth >= 3 else labels
    units = cut(grouping.sieved(cleaned.select("row_i", "col_i", "cluster"), sieve), "units")
    if mask is not None:
        units = clip.cells_in_mask(units, mask, meta)
    colours = pixels.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(centres)], "cluster int, r int, g int, b int")
    return polygons(units, meta, "cluster").withColumnRenamed("cluster", "cluster_id"), colours


def resolved_outlet(points: DataFrame | None, facc: DataFrame, meta: grid.GridMeta, radius: int = 25) -> tuple[DataFrame, DataFrame]:
    """(row_i, col_i of the outlet, warnings fid and message): the user's first point snapped to the most accumulation, or the best cell of the grid.

    A point off the grid is left out with a warning.
    """
    if points is None or points.isEmpty():
        return flow.auto_outlet(facc, meta.n_rows, meta.n_cols).select("row_i", "col_i"), facc.sparkSession.createDataFrame([], "fid long, message string")
    first, warned = checks.first_feature(points)
    cell = first.select("fid", meta.row_of(F.col("y")).alias("row_i"), meta.column_of(F.col("x")).alias("col_i"))
    inside = F.col("row_i").between(0, meta.n_rows - 1) & F.col("col_i").between(0, meta.n_cols - 1)
    off = cell.where(~inside).select("fid", F.lit("the outlet lies off the grid").alias("message"))
    return flow.snapped_outlets(cell.where(inside), facc, meta.n_cols, radius).select("row_i", "col_i"), warned.unionByName(off)


@dataclass
class Watershed:
    """subbasins with rank and hex_color; labels: node, label; outlets; encoding; warnings: fid, message."""

    subbasins: DataFrame
    labels: DataFrame
    outlets: DataFrame
    encoding: str
    warnings: DataFrame


def watershed(directions: DataFrame, facc: DataFrame | None, meta: grid.GridMeta, points: DataFrame | None = None, encoding: str = "auto", mode: str = "n", n_subbasins: int = 25, least_km2: float = 10.0, main_stem: bool = True, edges: bool = True) -> Watershed:
    """Sub-basins of flow directions (src, row_i, col_i, fdir): encoding, accumulation unless given, outlets, labels, statistics and colours.

    Unknown codes are an error. A user's point (fid, x, y) is snapped to the most accumulation near
    it, and is an outlet besides those chosen; without points the best cell of the grid is.
    """
    if encoding == "auto":
        encoding = flow.encoding(directions).first()["encoding"]
    if encoding not in flow.OFFSETS:
        raise ValueError("unrecognised flow direction codes")
    down = cut(flow.downstream(directions, meta.n_rows, meta.n_cols, encoding), "flow")
    facc = tiles.accumulation(down, meta.n_cols) if facc is None else facc.select("src", "facc")
    facc = cut(facc, "facc")
    cell_m2 = meta.cell_area_m2()
    found = cut(outlets.outlets(down, facc, meta.n_cols, cell_m2, mode, n_subbasins, least_km2 * 1e6, main_stem, edges), "outlets")
    warnings = found.groupBy().count().where("count = 0").select(F.lit(None).cast("long").alias("fid"), F.lit("no confluences found").alias("message"))
    spot, off = resolved_outlet(points, facc, meta)
    warnings = warnings.unionByName(off)
    own = spot.first()
    if own is not None:
        node = int(own["row_i"] * meta.n_cols + own["col_i"])
        area = (facc.where(F.col("src") == node).agg(F.max("facc")).first()[0] or 0.0) * cell_m2
        found = cut(flow.with_own_outlet(found, node, area), "outlets")
    main = found.agg(F.max_by("node", F.struct("area_m2", -F.col("place")))).first()[0]
    seeds = found.select("node", (F.col("place") + 1).alias("label"), "place")
    if main is not None:
        seeds = flow.with_trunk(tiles.path(down, main, meta.n_cols), seeds, main)
    labels = cut(tiles.labelled(down, seeds, meta.n_cols), "labels")
    parts = flow.subbasins(labels, facc, meta.n_cols, cell_m2, meta.x_of, meta.y_of)
    return Watershed(tables.ranked_colours(parts), labels, found, encoding, warnings)


def subbasin_layer(found: Watershed, meta: grid.GridMeta) -> DataFrame:
    """label_id, area_km2, rank, n_pixels, outlet_x, outlet_y, hex_color, wkt: sub-basins with their outlines."""
    row, col = F.floor(F.col("node") / meta.n_cols), F.col("node") % meta.n_cols
    kept = found.labels.join(found.subbasins.select(F.col("label_id").alias("label")), "label", "left_semi")
    rings = polygons(kept.select(row.alias("row_i"), col.alias("col_i"), "label"), meta)
    shapes = tables.polygon_wkt(rings.withColumnRenamed("label", "fid"))
    return found.subbasins.join(shapes.withColumnRenamed("fid", "label_id"), "label_id").select("label_id", "area_km2", "rank", "n_pixels", "outlet_x", "outlet_y", "hex_color", "wkt")
