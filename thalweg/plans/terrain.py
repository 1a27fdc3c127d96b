"""Queries on lines, swaths, basins and hypsometry, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, hypsometry, polylines, rose, series, swath, zones
from ..sources import fixtures as fx
from . import fixture_sql as sql

META = grid.GridMeta(fx.X0, fx.PIXEL_W, fx.Y0, fx.PIXEL_H, n_cols=fx.N_COLS)
STATIONS, HALF_WIDTH, ACROSS = 20, 200.0, 21


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def rose_segments(spark, sf):
    return polylines.segments(fx.lines(spark, sf)).select("fid", "vidx", *r6("dx", "dy", "len", "az"))


def _bins(spark, sf, mode, **options):
    half = options.get("half", False)
    return rose.histogram(rose.directions(fx.lines(spark, sf), **options), 36, mode, half).select("bin", "center", F.round("value", 4).alias("value"))


def rose_stats(spark, sf):
    found = rose.directions(fx.lines(spark, sf), axial=False)
    out = rose.statistics(found, rose.histogram(found))
    return out.select(
        F.round("dominant", 1).alias("dominant"), F.round("secondary", 1).alias("secondary"), F.round("mean", 1).alias("mean"), F.round("r", 4).alias("r"),
        F.round("anisotropy", 3).alias("anisotropy"), F.round("entropy", 4).alias("entropy"), "n", F.round("total_km", 2).alias("total_km"),
    )


def rose_rectitude(spark, sf):
    return polylines.rectitude(fx.lines(spark, sf)).select("fid", *r6("straight", "total", "rectitude"))


def raster_point_sample(spark, sf):
    return grid.sample(fx.lines(spark, sf), fx.elevation_cells(spark, sf), META, "z").select("fid", "vidx", "row_i", "col_i", "z")


def raster_window(spark, sf):
    return grid.window(fx.elevation_cells(spark, sf), META, 205.0, 455.0, 850.0, 995.0).select("row_i", "col_i", "z")


def line_stations(spark, sf):
    return polylines.stations(fx.lines(spark, sf), 50).select("fid", "station", *r6("dist", "x", "y"))


def line_pixel_walk(spark, sf):
    return polylines.walked(fx.lines(spark, sf), 100.0).select("fid", "idx", *r6("x", "y"))


def line_stretch(spark, sf):
    return polylines.between(fx.lines(spark, sf), F.lit(1000.0), F.lit(2500.0)).select("fid", "vidx", *r6("d", "x", "y"))


def swath_stats(spark, sf):
    out = swath.profile(fx.lines(spark, sf), fx.elevation_cells(spark, sf), META, STATIONS, HALF_WIDTH, ACROSS)
    return out.select("fid", "station", "n", *r6("mean", "min", "max", "relief", "hyps"))


def swath_quartiles(spark, sf):
    out = swath.profile(fx.lines(spark, sf), fx.elevation_cells(spark, sf), META, STATIONS, HALF_WIDTH, ACROSS, quartiles=True)
    return out.select("fid", "station", *r6("q1", "q3"))


def smooth_savgol(spark, sf):
    return series.smoothed(fx.profiles(spark, sf), "elev", 7).select("basin_id", "idx", *r6("smooth"))


def smooth_hanning(spark, sf):
    return series.smoothed(fx.profiles(spark, sf), "elev", 7, "hanning").select("basin_id", "idx", *r6("smooth"))


def profile_reorient(spark, sf):
    rising = fx.profiles(spark, sf).withColumn("elev", F.when(F.col("basin_id") % 2 == 0, -F.col("elev")).otherwise(F.col("elev")))
    return series.high_to_low(rising).select("basin_id", "idx", F.round("dist_m", 2).alias("dist_m"), "elev", "turn")


def local_slope(spark, sf):
    return series.slope(fx.profiles(spark, sf)).select("basin_id", "idx", F.round("slope", 6).alias("slope"))


def fac_fill(spark, sf):
    return series.filled(fx.profiles(spark, sf), "area_raw", "area_filled", 900.0).select("basin_id", "idx", "area_filled")


def hyps_stats(spark, sf):
    return hypsometry.summary(fx.elevation_cells(spark, sf)).select("basin_id", "n_cells", *[F.round(c, 1).alias(c) for c in ("z_min", "z_max", "relief")])


def hyps_skipped(spark, sf):
    return hypsometry.skipped(fx.elevation_cells(spark, sf), 368)


def hyps_curve(spark, sf):
    return hypsometry.curve(fx.elevation_cells(spark, sf), 100).select("basin_id", "p", *r6("area_fraction", "elev_fraction"))


def hyps_integral(spark, sf):
    out = hypsometry.integral(hypsometry.curve(fx.elevation_cells(spark, sf), 200))
    return out.select("basin_id", "hi", hypsometry.stage(F.col("hi")).alias("stage"))


def _results(spark, sf):
    """basin_id, hi, area_km2, relief of every basin."""
    cells = fx.elevation_cells(spark, sf)
    hi = hypsometry.integral(hypsometry.curve(cells, 200))
    area = grid.ring_areas(fx.basin_rings(spark, sf)).select(F.col("fid").alias("basin_id"), "area_km2")
    relief = hypsometry.summary(cells).select("basin_id", F.round("relief", 1).alias("relief"))
    return hi.join(relief, "basin_id").join(area, "basin_id", "left")


def _groups(spark, sf):
    return hypsometry.grouped(_results(spark, sf), "relief", "Relief")


def hyps_groups(spark, sf):
    return _groups(spark, sf).select("basin_id", "group_no", "group_label")


def hyps_group_chunks(spark, sf):
    return hypsometry.chunked(_groups(spark, sf), 6).select("basin_id", "group_no", "chunk", "chunk_label")


def hyps_group_stats(spark, sf):
    return hypsometry.group_statistics(_groups(spark, sf), "group_no")


def hyps_move_ungrouped(spark, sf):
    return hypsometry.group_statistics(hypsometry.moved_to_ungrouped(_groups(spark, sf), 3), "group_no", "group_label")


def basin_area_shoelace(spark, sf):
    return grid.ring_areas(fx.basin_rings(spark, sf)).select("fid", *r6("area_m2", "area_km2"))


def _doubled_rings(spark, sf):
    rings = fx.basin_rings(spark, sf)
    return rings.unionByName(rings.where("fid = 0").withColumn("fid", F.lit(1000000).cast("long")))


def basin_dedup(spark, sf):
    return grid.first_of_each_shape(_doubled_rings(spark, sf))[1]


def basin_labels(spark, sf):
    return grid.labels(fx.basins(spark, sf))


def natural_sort_labels(spark, sf):
    from pyspark.sql import Window

    named = grid.labels(fx.basins(spark, sf)).withColumn("key", grid.natural_key())
    # Places among the basins of ten: no window over all rows.
    w = Window.partitionBy(F.floor(F.col("fid") / 10)).orderBy("key", "fid")
    return named.select("fid", "label", F.row_number().over(w).cast("long").alias("place"))


def zonal_point_in_polygon(spark, sf):
    cells = fx.elevation_cells(spark, sf).select("row_i", "col_i", "z")
    inside = zones.cells_in_zones(cells, fx.basin_rings(spark, sf), META)
    return inside.groupBy("fid").agg(F.count("*").alias("n_cells"), F.count("z").alias("n_known"), F.round(F.avg("z"), 6).alias("z_mean"))


def nice_interval(spark, sf):
    spans = fx.profiles(spark, sf).groupBy("basin_id").agg((F.max("dist_m") / 8).alias("x"), ((F.max("elev") - F.min("elev")) / 6).alias("z"))
    return spans.select("basin_id", F.round(swath.nice_interval(F.col("x")), 6).alias("x_tick"), F.round(swath.nice_interval(F.col("z")), 6).alias("z_tick"))


QUERIES = {
    "rose_segments": rose_segments,
    "rose_bins_length": lambda s, d: _bins(s, d, "length"),
    "rose_bins_count": lambda s, d: _bins(s, d, "count"),
    "rose_bins_frequency": lambda s, d: _bins(s, d, "frequency"),
    "rose_half_bins": lambda s, d: _bins(s, d, "length", half=True),
    "rose_densified_bins": lambda s, d: _bins(s, d, "count", densify=100.0),
    "rose_straight_bins": lambda s, d: _bins(s, d, "length", min_length=50.0, min_rectitude=0.01),
    "rose_rectitude": rose_rectitude,
    "rose_stats": rose_stats,
    "raster_point_sample": raster_point_sample,
    "raster_window": raster_window,
    "line_stations": line_stations,
    "line_pixel_walk": line_pixel_walk,
    "line_stretch": line_stretch,
    "swath_stats": swath_stats,
    "swath_quartiles": swath_quartiles,
    "smooth_savgol": smooth_savgol,
    "smooth_hanning": smooth_hanning,
    "profile_reorient": profile_reorient,
    "local_slope": local_slope,
    "fac_fill": fac_fill,
    "hyps_stats": hyps_stats,
    "hyps_skipped": hyps_skipped,
    "hyps_curve": hyps_curve,
    "hyps_integral": hyps_integral,
    "hyps_groups": hyps_groups,
    "hyps_group_chunks": hyps_group_chunks,
    "hyps_group_stats": hyps_group_stats,
    "hyps_move_ungrouped": hyps_move_ungrouped,
    "basin_area_shoelace": basin_area_shoelace,
    "basin_dedup": basin_dedup,
    "basin_labels": basin_labels,
    "natural_sort_labels": natural_sort_labels,
    "zonal_point_in_polygon": zonal_point_in_polygon,
    "nice_interval": nice_interval,
}

_SEGS = f"""l AS ({sql.LINES}),
n AS (SELECT *, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2 FROM l WINDOW w AS (PARTITION BY fid ORDER BY vidx)),
s AS (SELECT fid, vidx, x2-x AS dx, y2-y AS dy, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS len,
  (degrees(atan2(x2-x, y2-y)) + 360.0) % 360.0 AS az FROM n WHERE x2 IS NOT NULL)"""


def _bin_sql(rows: str, value: str, width: float, n: int = 36, total: str = "") -> str:
    return f"""WITH {_SEGS}, a AS ({rows}),
b AS (SELECT LEAST(CAST(FLOOR(az/{width}) AS BIGINT), {n - 1}) AS bin, {value} AS v FROM a GROUP BY 1)
SELECT r.bin, CAST((r.bin + 0.5)*{width} AS DOUBLE) AS center, round(coalesce(v, 0.0){total}, 4) AS value
FROM (SELECT CAST(range AS BIGINT) AS bin FROM range({n})) r LEFT JOIN b ON r.bin = b.bin"""


_BOTH = "SELECT az, len FROM s UNION ALL SELECT (az + 180.0) % 360.0, len FROM s"
_CUM = f"""l AS ({sql.LINES}),
d AS (SELECT *, sqrt((x-LAG(x) OVER w)*(x-LAG(x) OVER w)+(y-LAG(y) OVER w)*(y-LAG(y) OVER w)) AS d FROM l WINDOW w AS (PARTITION BY fid ORDER BY vidx)),
c AS (SELECT fid, vidx, x, y, SUM(coalesce(d, 0)) OVER (PARTITION BY fid ORDER BY vidx ROWS UNBOUNDED PRECEDING) AS cum FROM d),
p AS (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(cum) OVER w AS pcum FROM c WINDOW w AS (PARTITION BY fid ORDER BY vidx))"""


def _stations_sql(n: int) -> str:
    return f"""{_CUM},
k AS (SELECT fid, range AS station, CASE WHEN range = {n - 1} THEN total ELSE total * range / {float(n - 1)} END AS dist
  FROM (SELECT fid, MAX(cum) AS total FROM c GROUP BY fid) t, range({n})),
f AS (SELECT k.fid, k.station, k.dist, MIN(p.vidx) AS vidx FROM k JOIN p ON p.fid = k.fid AND p.pcum IS NOT NULL AND p.cum >= k.dist GROUP BY ALL),
st AS (SELECT f.fid, f.station, f.dist,
  CASE WHEN cum - pcum < 1e-10 THEN x ELSE px + (dist - pcum)/(cum - pcum)*(x - px) END AS x,
  CASE WHEN cum - pcum < 1e-10 THEN y ELSE py + (dist - pcum)/(cum - pcum)*(y - py) END AS y
  FROM f JOIN p ON p.fid = f.fid AND p.vidx = f.vidx)"""


_SWATH = f"""{_stations_sql(STATIONS)},
tg AS (SELECT *, coalesce(LEAD(x) OVER w, x) - coalesce(LAG(x) OVER w, x) AS dx, coalesce(LEAD(y) OVER w, y) - coalesce(LAG(y) OVER w, y) AS dy
  FROM st WINDOW w AS (PARTITION BY fid ORDER BY station)),
tr AS (SELECT fid, station, x + (-1.0 + 2.0*range/{float(ACROSS - 1)})*{HALF_WIDTH}*(-dy)/sqrt(dx*dx+dy*dy) AS tx,
  y + (-1.0 + 2.0*range/{float(ACROSS - 1)})*{HALF_WIDTH}*dx/sqrt(dx*dx+dy*dy) AS ty FROM tg, range({ACROSS})),
cell AS ({sql.CELLS}),
sm AS (SELECT fid, station, z FROM tr LEFT JOIN cell ON row_i = CAST(FLOOR((ty - 1000.0)/-10.0) AS BIGINT) AND col_i = CAST(FLOOR(tx/10.0) AS BIGINT))"""


def _smooth_sql(weights: list[float]) -> str:
    half = len(weights) // 2
    n = "COUNT(*) OVER (PARTITION BY basin_id)"
    terms = " + ".join(f"{w!r} * e[LEAST(GREATEST(idx + 1 + ({j - half}), 1), n)]" for j, w in enumerate(weights))
    return f"""WITH p AS ({sql.PROFILES}),
a AS (SELECT basin_id, idx, {n} AS n, list(elev) OVER (PARTITION BY basin_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM p)
SELECT basin_id, idx, round({terms}, 6) AS smooth FROM a"""


def _hyps_sql(points: int) -> str:
    return f"""c AS ({sql.CELLS}),
k AS (SELECT basin_id, z, ROW_NUMBER() OVER (PARTITION BY basin_id ORDER BY z DESC) - 1 AS rk, COUNT(*) OVER (PARTITION BY basin_id) AS n,
  MIN(z) OVER (PARTITION BY basin_id) AS lo, MAX(z) OVER (PARTITION BY basin_id) AS hi FROM c WHERE z IS NOT NULL),
h AS (SELECT basin_id, range AS p, range / {float(points - 1)} AS area_fraction, CASE WHEN hi - lo > 1e-10 THEN (z - lo)/(hi - lo) ELSE 0.5 END AS elev_fraction
  FROM k, range({points}) WHERE n >= 10 AND rk = (range * (n - 1)) // {points - 1}),
g AS (SELECT basin_id, round(SUM(a), 4) AS hi FROM (SELECT basin_id, (elev_fraction + LAG(elev_fraction) OVER w)/2*(area_fraction - LAG(area_fraction) OVER w) AS a
  FROM h WINDOW w AS (PARTITION BY basin_id ORDER BY p)) t GROUP BY basin_id)"""


_FMT = "CASE WHEN abs({v}) < 10 THEN printf('%.2f', {v}) ELSE printf('%.0f', {v}) END"
_GROUPS = f"""{_hyps_sql(200)},
b AS ({sql.BASINS}),
q AS (SELECT basin_id, round(MAX(z) - MIN(z), 1) AS relief FROM c WHERE z IS NOT NULL GROUP BY basin_id HAVING COUNT(*) >= 10),
res AS (SELECT g.basin_id, g.hi, q.relief, (x_max - x_min)*(y_max - y_min)/1e6 AS area_km2 FROM g JOIN q USING (basin_id) LEFT JOIN b ON b.fid = g.basin_id),
m AS (SELECT MIN(relief) AS lo, MAX(relief) AS hi_ FROM res),
e AS (SELECT res.*, lo, hi_, CASE WHEN hi_ - lo < 1e-9 THEN 0 WHEN relief < lo + (hi_-lo)*1/4 THEN 0 WHEN relief < lo + (hi_-lo)*2/4 THEN 1 WHEN relief < lo + (hi_-lo)*3/4 THEN 2 ELSE 3 END AS group_no FROM res, m),
gr AS (SELECT basin_id, hi, relief, area_km2, CAST(group_no AS INTEGER) AS group_no, CASE WHEN hi_ - lo < 1e-9 THEN 'Relief ' || {_FMT.format(v="lo")}
  ELSE 'Relief ' || {_FMT.format(v="(lo + (hi_-lo)*group_no/4)")} || ' – ' || CASE WHEN group_no = 3 THEN {_FMT.format(v="hi_")} ELSE {_FMT.format(v="(lo + (hi_-lo)*(group_no+1)/4)")} END END AS group_label FROM e)"""
_GROUP_STATS = "COUNT(*) AS n, " + ", ".join(  # rounded as decimals: half away from zero, as written
    f"CAST(round(CAST({f}({c}) AS DECIMAL(24,9)), {d}) AS DOUBLE) AS {name}"
    for f, c, d, name in (
        ("MIN", "hi", 3, "hi_min"), ("MAX", "hi", 3, "hi_max"), ("AVG", "hi", 3, "hi_mean"), ("SUM", "area_km2", 1, "area_total_km2"),
        ("AVG", "area_km2", 1, "area_mean_km2"), ("AVG", "relief", 1, "relief_mean"),
    )
)

ORACLES = {
    "rose_segments": f"WITH {_SEGS} SELECT fid, vidx, round(dx, 6) AS dx, round(dy, 6) AS dy, round(len, 6) AS len, round(az, 6) AS az FROM s",
    "rose_bins_length": _bin_sql(_BOTH, "SUM(len)", 10.0),
    "rose_bins_count": _bin_sql(_BOTH, "CAST(COUNT(*) AS DOUBLE)", 10.0),
    "rose_bins_frequency": _bin_sql(_BOTH, "SUM(len)", 10.0, total=" / (SELECT SUM(v) FROM b) * 100"),
    "rose_half_bins": _bin_sql("SELECT az % 180.0 AS az, len FROM s", "SUM(len)", 5.0),
    "rose_densified_bins": _bin_sql(
        "SELECT az, k FROM (SELECT az, CASE WHEN len > 100.0 THEN CAST(FLOOR(len/100.0) AS BIGINT) ELSE 1 END AS k FROM s) t"
        " UNION ALL SELECT (az + 180.0) % 360.0, CASE WHEN len > 100.0 THEN CAST(FLOOR(len/100.0) AS BIGINT) ELSE 1 END FROM s",
        "CAST(SUM(k) AS DOUBLE)",
        10.0,
    ),
    "rose_straight_bins": _bin_sql(
        "SELECT az, len FROM st UNION ALL SELECT (az + 180.0) % 360.0, len FROM st".replace(
            "st",
            "(SELECT s.* FROM s JOIN (SELECT s2.fid, SUM(s2.len) AS total, ANY_VALUE(e.d) AS d FROM s s2 JOIN (SELECT fid, sqrt((arg_max(x, vidx)-arg_min(x, vidx))**2"
            " + (arg_max(y, vidx)-arg_min(y, vidx))**2) AS d FROM l GROUP BY fid) e ON e.fid = s2.fid GROUP BY s2.fid) k ON k.fid = s.fid AND k.d/k.total >= 0.01 WHERE s.len >= 50.0) z",
        ),
        "SUM(len)",
        10.0,
    ),
    "rose_rectitude": f"""WITH {_SEGS}, e AS (SELECT fid, sqrt((arg_max(x, vidx)-arg_min(x, vidx))**2 + (arg_max(y, vidx)-arg_min(y, vidx))**2) AS straight FROM l GROUP BY fid),
t AS (SELECT fid, SUM(len) AS total FROM s GROUP BY fid)
SELECT e.fid, round(straight, 6) AS straight, round(coalesce(total, 0.0), 6) AS total, round(CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE straight/total END, 6) AS rectitude
FROM e LEFT JOIN t ON e.fid = t.fid""",
    "rose_stats": f"""WITH {_SEGS}, b AS (SELECT r.range AS bin, coalesce(SUM(len), 0) AS v FROM range(36) r LEFT JOIN s ON LEAST(CAST(FLOOR(az/10) AS BIGINT), 35) = r.range GROUP BY 1),
top AS (SELECT arg_max(bin, v - bin*1e-9) AS top, SUM(v) AS total, MAX(v) AS most FROM b),
sec AS (SELECT bin FROM b, top WHERE NOT ((bin - top + 36) % 36 IN (0, 1, 35)) ORDER BY v DESC, bin LIMIT 1),
c AS (SELECT SUM(sin(radians(az))*len)/SUM(len) AS sn, SUM(cos(radians(az))*len)/SUM(len) AS cs, COUNT(*) AS n, SUM(len)/1000 AS km FROM s)
SELECT round((top + 0.5)*10.0, 1)::DOUBLE AS dominant, round(((SELECT bin FROM sec) + 0.5)*10.0, 1)::DOUBLE AS secondary, round((degrees(atan2(sn, cs)) + 360.0) % 360.0, 1) AS mean,
round(sqrt(sn*sn + cs*cs), 4) AS r, round(most/total, 3) AS anisotropy, (SELECT round(-SUM(v/total*log2(v/total)), 4) FROM b, top WHERE v > 0) AS entropy, n, round(km, 2) AS total_km FROM top, c""",
    "raster_point_sample": f"""WITH l AS ({sql.LINES}), c AS ({sql.CELLS}), k AS (SELECT fid, vidx, CAST(FLOOR((y - 1000.0)/-10.0) AS BIGINT) AS row_i, CAST(FLOOR(x/10.0) AS BIGINT) AS col_i FROM l)
SELECT k.fid, k.vidx, k.row_i, k.col_i, c.z FROM k LEFT JOIN c ON c.row_i = k.row_i AND c.col_i = k.col_i""",
    "raster_window": f"SELECT row_i, col_i, z FROM ({sql.CELLS}) c WHERE row_i BETWEEN 0 AND 15 AND col_i BETWEEN 20 AND 45",
    "line_stations": f"WITH {_stations_sql(50)} SELECT fid, CAST(station AS BIGINT) AS station, round(dist, 6) AS dist, round(x, 6) AS x, round(y, 6) AS y FROM st",
    "line_pixel_walk": f"""WITH l AS ({sql.LINES}), n AS (SELECT *, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2 FROM l WINDOW w AS (PARTITION BY fid ORDER BY vidx)),
k AS (SELECT *, GREATEST(CAST(CEIL(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))/30.0) AS BIGINT), 1) AS steps FROM n WHERE x2 IS NOT NULL),
e AS (SELECT *, unnest(range(steps)) AS st FROM k)
SELECT fid, ROW_NUMBER() OVER (PARTITION BY fid ORDER BY vidx, st) - 1 AS idx, round(x + st/CAST(steps AS DOUBLE)*(x2-x), 6) AS x, round(y + st/CAST(steps AS DOUBLE)*(y2-y), 6) AS y FROM e""",
    "line_stretch": f"""WITH {_CUM}, k AS (SELECT * FROM p WHERE pcum IS NOT NULL AND cum > pcum AND cum > 1000 AND pcum < 2500),
e AS (SELECT fid, px, py, x, y, cum, pcum, GREATEST(pcum, 1000.0) AS d FROM k UNION ALL SELECT fid, px, py, x, y, cum, pcum, LEAST(cum, 2500.0) FROM k),
u AS (SELECT DISTINCT fid, d, px + (d-pcum)/(cum-pcum)*(x-px) AS x, py + (d-pcum)/(cum-pcum)*(y-py) AS y FROM e)
SELECT fid, ROW_NUMBER() OVER (PARTITION BY fid ORDER BY d) - 1 AS vidx, round(d, 6) AS d, round(x, 6) AS x, round(y, 6) AS y FROM u""",
    "swath_stats": f"""WITH {_SWATH} SELECT fid, CAST(station AS BIGINT) AS station, COUNT(z) AS n, round(AVG(z), 6) AS mean, round(MIN(z), 6) AS min, round(MAX(z), 6) AS max, round(MAX(z)-MIN(z), 6) AS relief,
round(CASE WHEN COUNT(z) = 0 THEN NULL WHEN MAX(z)-MIN(z) > 1e-6 THEN (AVG(z)-MIN(z))/(MAX(z)-MIN(z)) ELSE 0.5 END, 6) AS hyps FROM sm GROUP BY fid, station""",
    "swath_quartiles": f"WITH {_SWATH} SELECT fid, CAST(station AS BIGINT) AS station, round(quantile_cont(z, 0.25), 6) AS q1, round(quantile_cont(z, 0.75), 6) AS q3 FROM sm GROUP BY fid, station",
    "smooth_savgol": _smooth_sql(series.savgol_weights(7)),
    "smooth_hanning": _smooth_sql(series.hanning_weights(7)),
    "profile_reorient": f"""WITH p AS (SELECT basin_id, idx, dist_m, CASE WHEN basin_id % 2 = 0 THEN -elev ELSE elev END AS elev FROM ({sql.PROFILES}) q),
a AS (SELECT *, FIRST_VALUE(elev) OVER w < LAST_VALUE(elev) OVER w AS turn, COUNT(*) OVER w AS n, LAST_VALUE(dist_m) OVER w AS total FROM p
  WINDOW w AS (PARTITION BY basin_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT basin_id, CASE WHEN turn THEN n - 1 - idx ELSE idx END AS idx, round(CASE WHEN turn THEN total - dist_m ELSE dist_m END, 2) AS dist_m, elev, turn FROM a""",
    "local_slope": f"""WITH p AS ({sql.PROFILES}), a AS (SELECT basin_id, idx, coalesce(LEAD(elev) OVER w, elev) - coalesce(LAG(elev) OVER w, elev) AS dz,
coalesce(LEAD(dist_m) OVER w, dist_m) - coalesce(LAG(dist_m) OVER w, dist_m) AS dd FROM p WINDOW w AS (PARTITION BY basin_id ORDER BY idx))
SELECT basin_id, idx, round(CASE WHEN dd > 1e-6 THEN GREATEST(abs(dz)/dd, 1e-8) ELSE 1e-8 END, 6) AS slope FROM a""",
    "fac_fill": f"""WITH p AS ({sql.PROFILES}), a AS (SELECT basin_id, idx, coalesce(LAST_VALUE(area_raw IGNORE NULLS) OVER (PARTITION BY basin_id ORDER BY idx ROWS UNBOUNDED PRECEDING),
FIRST_VALUE(area_raw IGNORE NULLS) OVER (PARTITION BY basin_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM p)
SELECT basin_id, idx, CASE WHEN v <= 0 THEN 900.0 ELSE v END AS area_filled FROM a""",
    "hyps_stats": f"SELECT basin_id, COUNT(*) AS n_cells, round(MIN(z), 1) AS z_min, round(MAX(z), 1) AS z_max, round(MAX(z)-MIN(z), 1) AS relief FROM ({sql.CELLS}) c WHERE z IS NOT NULL GROUP BY basin_id HAVING COUNT(*) >= 10",
    "hyps_skipped": f"SELECT basin_id, 'insufficient valid pixels' AS reason FROM ({sql.CELLS}) c GROUP BY basin_id HAVING COUNT(z) < 368",
    "hyps_curve": f"WITH {_hyps_sql(100)} SELECT basin_id, p, round(area_fraction, 6) AS area_fraction, round(elev_fraction, 6) AS elev_fraction FROM h",
    "hyps_integral": f"WITH {_hyps_sql(200)} SELECT basin_id, hi, CASE WHEN hi >= 0.6 THEN 'young' WHEN hi < 0.4 THEN 'old' ELSE 'mature' END AS stage FROM g",
    "hyps_groups": f"WITH {_GROUPS} SELECT basin_id, group_no, group_label FROM gr",
    "hyps_group_chunks": f"""WITH {_GROUPS}, kk AS (SELECT *, COUNT(*) OVER (PARTITION BY group_no) AS n, ROW_NUMBER() OVER (PARTITION BY group_no ORDER BY basin_id) - 1 AS pos FROM gr),
j AS (SELECT *, CASE WHEN n > 6 THEN pos // 6 ELSE 0 END AS chunk FROM kk)
SELECT basin_id, group_no, chunk, CASE WHEN n > 6 THEN group_label || '  [' || (chunk*6 + 1) || '–' || (chunk*6 + LEAST(6, n - chunk*6)) || ']  ·  ' || LEAST(6, n - chunk*6) || ' curves' ELSE group_label END AS chunk_label FROM j""",
    "hyps_group_stats": f"WITH {_GROUPS} SELECT group_no, {_GROUP_STATS} FROM gr GROUP BY group_no",
    "hyps_move_ungrouped": f"""WITH {_GROUPS} SELECT CAST(CASE WHEN basin_id = 3 THEN 1073741824 ELSE group_no END AS INTEGER) AS group_no, CASE WHEN basin_id = 3 THEN 'Ungrouped' ELSE group_label END AS group_label, {_GROUP_STATS}
FROM gr GROUP BY 1, 2""",
    "basin_area_shoelace": f"SELECT fid, round((x_max-x_min)*(y_max-y_min), 6) AS area_m2, round((x_max-x_min)*(y_max-y_min)/1e6, 6) AS area_km2 FROM ({sql.BASINS}) b",
    "basin_dedup": f"""WITH b AS (SELECT * FROM ({sql.BASINS}) q UNION ALL SELECT 1000000, label, x_min, x_max, y_min, y_max FROM ({sql.BASINS}) q WHERE fid = 0),
k AS (SELECT fid, ROW_NUMBER() OVER (PARTITION BY x_min, x_max, y_min, y_max ORDER BY fid) AS rn FROM b) SELECT CAST(fid AS BIGINT) AS fid, 'duplicate geometry' AS reason FROM k WHERE rn > 1""",
    "basin_labels": f"SELECT fid, coalesce(nullif(trim(label), ''), 'Basin_' || fid) AS label FROM ({sql.BASINS}) b",
    "natural_sort_labels": f"""WITH b AS (SELECT fid, coalesce(nullif(trim(label), ''), 'Basin_' || fid) AS label FROM ({sql.BASINS}) q)
SELECT fid, label, ROW_NUMBER() OVER (PARTITION BY fid // 10 ORDER BY regexp_replace(lower(label), '[0-9]+', ''), CAST(regexp_extract(label, '[0-9]+') AS BIGINT), fid) AS place FROM b""",
    "zonal_point_in_polygon": f"""WITH c AS ({sql.CELLS}), b AS ({sql.BASINS}), p AS (SELECT z, (col_i + 0.5)*10.0 AS x, 1000.0 + (row_i + 0.5)*-10.0 AS y FROM c)
SELECT fid, COUNT(*) AS n_cells, COUNT(z) AS n_known, round(AVG(z), 6) AS z_mean FROM p JOIN b ON x >= x_min AND x < x_max AND y >= y_min AND y < y_max GROUP BY fid""",
    "nice_interval": f"""WITH s AS (SELECT basin_id, MAX(dist_m)/8 AS x, (MAX(elev)-MIN(elev))/6 AS z FROM ({sql.PROFILES}) p GROUP BY basin_id),
m AS (SELECT *, CASE WHEN x > 0 THEN pow(10.0, floor(log10(x))) END AS mx, CASE WHEN z > 0 THEN pow(10.0, floor(log10(z))) END AS mz FROM s)
SELECT basin_id, CASE WHEN x > 0 THEN round(mx * CASE WHEN x/mx < 1.5 THEN 1.0 WHEN x/mx < 3 THEN 2.0 WHEN x/mx < 7 THEN 5.0 ELSE 10.0 END, 6) ELSE 1.0 END AS x_tick,
CASE WHEN z > 0 THEN round(mz * CASE WHEN z/mz < 1.5 THEN 1.0 WHEN z/mz < 3 THEN 2.0 WHEN z/mz < 7 THEN 5.0 ELSE 10.0 END, 6) ELSE 1.0 END AS z_tick FROM m""",
}
