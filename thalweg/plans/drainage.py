"""Queries on D8 flow, stream networks and map units, with their SQL oracles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import filling, flow, mapunits, network, outlets, outlines, parts, tables, tiles
from ..operators import tools as whole
from ..sources import fixtures as fx
from . import fixture_sql as sql
from .terrain import META

N_COLS, CELL_M2 = fx.N_COLS, 100.0


def _rows(spark, sf):
    return int(fx.read(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]) // N_COLS + 1


def _flow(spark, sf):
    return flow.downstream(fx.flow_cells(spark, sf), _rows(spark, sf), N_COLS)


def _facc(spark, sf):
    return cut(tiles.accumulation(_flow(spark, sf), N_COLS), "facc")


def _value(spark, sf):
    """A stand-in accumulation that SQL has without recursion."""
    return fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") % 977).cast("double").alias("facc"))


def _seeds(spark, sf):
    return fx.flow_cells(spark, sf).where("src % 371 = 0").select(F.col("src").alias("node"), (F.floor(F.col("src") / 371) + 1).cast("long").alias("label"))


def d8_encoding(spark, sf):
    cells = fx.flow_cells(spark, sf)
    named = lambda c, name: flow.encoding(c).select(F.lit(name).alias("raster"), "encoding")
    esri = cells.withColumn("fdir", F.expr("CASE WHEN src = 0 THEN 16 WHEN fdir = 5 THEN 8 WHEN fdir = 6 THEN 4 ELSE 2 END"))
    saga = cells.withColumn("fdir", F.expr("CASE WHEN src = 0 THEN 0 WHEN fdir = 5 THEN 5 WHEN fdir = 6 THEN 4 ELSE 3 END"))
    wrong = cells.withColumn("fdir", F.col("fdir") + 4)
    return named(cells, "grass").unionByName(named(esri, "esri")).unionByName(named(saga, "saga")).unionByName(named(wrong, "wrong"))


def d8_downstream(spark, sf):
    return _flow(spark, sf)


def d8_confluences(spark, sf):
    return flow.confluences(_flow(spark, sf), _value(spark, sf))


def d8_accumulation(spark, sf):
    return _facc(spark, sf)


def d8_labels(spark, sf):
    return tiles.labelled(_flow(spark, sf), _seeds(spark, sf), N_COLS)


def d8_trunk_labels(spark, sf):
    seeds = _seeds(spark, sf).withColumn("place", F.col("label"))
    return tiles.labelled(_flow(spark, sf), flow.with_trunk(tiles.path(_flow(spark, sf), 371, N_COLS), seeds, 371), N_COLS)


def d8_path(spark, sf):
    return tiles.path(_flow(spark, sf), 371, N_COLS)


def subbasin_stats(spark, sf):
    labels = tiles.labelled(_flow(spark, sf), _seeds(spark, sf), N_COLS)
    return flow.subbasins(labels, _value(spark, sf), N_COLS, CELL_M2, META.x_of, META.y_of).withColumn("rank", F.col("rank").cast("long"))


def outlet_auto(spark, sf):
    return flow.auto_outlet(_value(spark, sf), _rows(spark, sf), N_COLS)


def outlet_snap(spark, sf):
    number = F.col("c_custkey")
    points = fx.read(spark, sf, "customer").select(number.alias("fid"), F.floor(number / N_COLS).alias("row_i"), (number % N_COLS).alias("col_i"))
    return flow.snapped_outlets(points, _value(spark, sf), N_COLS)


def outlets_greedy(spark, sf):
    return outlets.outlets(_flow(spark, sf), _facc(spark, sf), N_COLS, CELL_M2)


def outlets_by_area(spark, sf):
    return outlets.outlets(_flow(spark, sf), _facc(spark, sf), N_COLS, CELL_M2, "area", least_m2=2500.0)


def d8_accumulation_gaps(spark, sf):
    """Over a grid without the cells that have no elevation: flow to them ends."""
    there = _elevations(spark, sf).where("z is not null").select("src")
    return tiles.accumulation(_flow(spark, sf).join(there, "src", "left_semi"), N_COLS)


def _elevations(spark, sf):
    return fx.elevation_cells(spark, sf).withColumn("src", F.col("row_i") * N_COLS + F.col("col_i"))


def flow_from_dem(spark, sf):
    return filling.flow(_elevations(spark, sf), N_COLS, (fx.PIXEL_W, fx.PIXEL_H)).select("src", "dst", F.round("level", 6).alias("level"))


def fac_from_dem(spark, sf):
    return whole.accumulation_of(None, fx.elevation_cells(spark, sf), META)[0].select("src", "facc")


def _meta(spark, sf):
    return replace(META, n_rows=_rows(spark, sf))


def watershed(spark, sf):
    """From flow directions to sub-basins: accumulation, outlets, trunk, labels, statistics, colours."""
    found = whole.watershed(fx.flow_cells(spark, sf), None, _meta(spark, sf))
    return found.subbasins


def watershed_totals(spark, sf):
    """Sub-basins and their area in all, as the page shows them."""
    found = whole.watershed(fx.flow_cells(spark, sf), None, _meta(spark, sf))
    return tables.watershed_totals(tables.watershed(found.subbasins))


def watershed_by_area(spark, sf):
    """Sub-basins upstream of confluences with a threshold, above a user's own outlet."""
    spot = spark.createDataFrame([(1, 505.0, 805.0)], "fid long, x double, y double")
    return whole.watershed(fx.flow_cells(spark, sf), None, _meta(spark, sf), spot, "grass", "area", least_km2=0.004, main_stem=False).subbasins


def watershed_layer(spark, sf):
    """Outlines of sub-basins: corners, and the area that they enclose in cells, beside the cells counted."""
    found = whole.watershed(fx.flow_cells(spark, sf), None, _meta(spark, sf))
    return whole.subbasin_layer(found, _meta(spark, sf)).select("label_id", "area_km2", "rank", "hex_color", F.length("wkt").alias("n_chars"))


def mask_edges(spark, sf):
    cells = fx.elevation_cells(spark, sf).where("z is not null").withColumn("label", F.col("basin_id"))
    return flow.outline_edges(cells).groupBy("label").agg(F.count("*").alias("n_edges"), F.sum(F.col("r0") + F.col("r1") + F.col("c0") + F.col("c1")).alias("checksum"))


def mask_rings(spark, sf):
    """The rings around areas of one basin with known elevations: corners, area in cells, and whether it is a hole."""
    cells = fx.elevation_cells(spark, sf).where("z is not null").withColumn("label", F.col("basin_id"))
    w = Window.partitionBy("label", "ring").orderBy("vidx")
    cross = F.col("c") * F.lead("r").over(w) - F.lead("c").over(w) * F.col("r")
    each = outlines.rings(cells, N_COLS).withColumn("cross", cross).groupBy("label", "ring").agg(F.count("cross").alias("n_corners"), F.sum("cross").alias("s"))
    return each.select("label", "ring", "n_corners", (F.abs("s") / 2).alias("area"), (F.col("s") < 0).alias("hole"))


def stream_downhill(spark, sf):
    s = fx.stream_segments(spark, sf).withColumn("z_start", F.when(F.col("seg_id") % 3 != 0, F.col("seg_id") * 1.0)).withColumn("z_end", (F.col("seg_id") % 50) * 2.0)
    return network.downhill(s).select("basin_id", "seg_id", "start_x", "start_y", "end_x", "end_y", "z_start", "z_end", "turned")


def snap_join(spark, sf):
    return network.snapped(fx.stream_segments(spark, sf), 2.0)


def river_weights(spark, sf):
    s = fx.stream_segments(spark, sf)
    return network.weights(s, network.snapped(s)).select("basin_id", "seg_id", F.round("weight", 2).alias("weight"))


def main_river(spark, sf):
    s = fx.stream_segments(spark, sf)
    return network.main_river(s, network.snapped(s))


def stream_clip(spark, sf):
    ends = fx.lines(spark, sf)
    w = Window.partitionBy("fid").orderBy("vidx")
    segs = ends.select((F.col("fid") * 1000 + F.col("vidx")).alias("seg_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    parts = network.clipped(segs, fx.basins(spark, sf), 250.0)
    return parts.groupBy("fid").agg(F.count("*").alias("n"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 3).alias("total"))


CENTRES = [(20.0, 30.0, 40.0), (200.0, 60.0, 90.0), (120.0, 220.0, 10.0), (60.0, 128.0, 250.0)]


def kmeans_assign(spark, sf):
    return mapunits.moved(fx.pixels(spark, sf), CENTRES).select("cluster", *[F.round(c, 6).alias(c) for c in "rgb"], "n")


def kmeans(spark, sf):
    labels, centres = mapunits.kmeans(fx.pixels(spark, sf), 4, N_COLS, rounds=10)
    shown = F.create_map(*[F.lit(x) for i, (r, g, b) in enumerate(centres) for x in (i, f"#{r:02x}{g:02x}{b:02x}")])
    return labels.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("hex_color", shown[F.col("cluster")])


def _quarters(spark, sf):
    """Pixels in four classes by brightness."""
    return fx.pixels(spark, sf).select("row_i", "col_i", F.least(F.floor((F.col("r") + F.col("g")) / 128), F.lit(3).cast("long")).alias("cluster"))


def median_filter(spark, sf):
    return mapunits.median(_quarters(spark, sf), _rows(spark, sf), N_COLS, 3)


def components(spark, sf):
    return parts.parts(_quarters(spark, sf)).groupBy("part", "cluster").agg(F.count("*").alias("n"))


def components_sieve(spark, sf):
    return parts.sieved(mapunits.median(_quarters(spark, sf), _rows(spark, sf), N_COLS, 5), 6).groupBy("cluster").agg(F.count("*").alias("n"))


def hex_colours(spark, sf):
    p = fx.pixels(spark, sf)
    return p.select("row_i", "col_i", mapunits.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("hex_color"))


QUERIES = {
    f.__name__: f
    for f in (
        d8_encoding, d8_downstream, d8_confluences, d8_accumulation, d8_path, d8_labels, d8_trunk_labels, subbasin_stats, outlet_auto, outlet_snap, outlets_greedy, outlets_by_area, watershed, watershed_totals, watershed_by_area, watershed_layer,
        d8_accumulation_gaps, flow_from_dem, fac_from_dem,
        mask_edges, mask_rings, stream_downhill, snap_join, river_weights, main_river, stream_clip, kmeans_assign, kmeans, median_filter, components, components_sieve, hex_colours,
    )
}

_F = f"""f0 AS ({sql.FLOW}), mx AS (SELECT MAX(src)//100 AS last FROM f0),
f AS (SELECT src, CASE WHEN row_i + 1 <= last AND col_i + (fdir - 6) BETWEEN 0 AND 99 THEN (row_i + 1)*100 + col_i + (fdir - 6) ELSE src END AS dst FROM f0, mx)"""
_V = "v AS (SELECT o_orderkey AS src, CAST(o_custkey % 977 AS DOUBLE) AS facc FROM orders)"
_SEEDS = "sd AS (SELECT src AS node, src//371 + 1 AS label FROM f0 WHERE src % 371 = 0)"
_WALK = """wk(origin, node, step) AS (SELECT src, src, 0 FROM f UNION ALL SELECT origin, f.dst, step + 1 FROM wk JOIN f ON wk.node = f.src WHERE f.dst <> f.src AND node NOT IN (SELECT node FROM sd)),
lb AS (SELECT f.src AS node, coalesce(MAX(sd.label), 0) AS label FROM f LEFT JOIN wk ON wk.origin = f.src LEFT JOIN sd ON sd.node = wk.node GROUP BY f.src)"""
_SNAP = f"""s AS ({sql.SEGMENTS}), ln AS (SELECT a.basin_id, a.seg_id, b.seg_id AS up_seg_id FROM s a JOIN s b ON a.basin_id = b.basin_id AND a.seg_id <> b.seg_id
  AND pow(a.start_x-b.end_x, 2) + pow(a.start_y-b.end_y, 2) <= 4.0)"""
_WEIGHT = f"""{_SNAP}, up(basin_id, seg_id, node, total) AS (SELECT basin_id, seg_id, seg_id, len_m FROM s UNION ALL
  SELECT up.basin_id, up.seg_id, ln.up_seg_id, total + s.len_m FROM up JOIN ln ON ln.basin_id = up.basin_id AND ln.seg_id = up.node JOIN s ON s.basin_id = ln.basin_id AND s.seg_id = ln.up_seg_id),
wt AS (SELECT basin_id, seg_id, MAX(total) AS weight FROM up GROUP BY basin_id, seg_id)"""
_DIST = " ".join(f"WHEN d{i} <= LEAST({', '.join(f'd{j}' for j in range(4))}) THEN {i}" for i in range(4))
_Q = f"q AS (SELECT row_i, col_i, LEAST((r + g)//128, 3) AS cluster FROM ({sql.PIXELS}) p)"

_STEPS8 = " UNION ALL ".join(f"SELECT {dr} AS dr, {dc} AS dc" for dr, dc in filling.STEPS)
#: Filled levels by a priority flood as a fixpoint, directions, steps over flats.
_DEM = f"""g AS (SELECT row_i*100 + col_i AS cell, row_i AS r, col_i AS c, z FROM ({sql.CELLS}) k WHERE z IS NOT NULL),
st AS ({_STEPS8}), nb AS (SELECT a.cell AS src, b.cell AS dst, b.z, sqrt(dr*dr*100.0 + dc*dc*100.0) AS d FROM g a, st JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc),
bs AS (SELECT cell FROM g WHERE cell NOT IN (SELECT src FROM nb GROUP BY src HAVING COUNT(*) = 8)),
fl(cell, level) USING KEY (cell) AS (SELECT cell, z FROM g WHERE cell IN (SELECT cell FROM bs)
  UNION SELECT nb.dst, MIN(GREATEST(nb.z, fl.level)) FROM fl JOIN nb ON nb.src = fl.cell LEFT JOIN recurring.fl o ON o.cell = nb.dst WHERE o.level IS NULL OR GREATEST(nb.z, fl.level) < o.level GROUP BY nb.dst),
dn AS (SELECT nb.src, nb.dst, a.level AS la, b.level AS lb, (a.level - b.level)/d AS drop FROM nb JOIN fl a ON a.cell = nb.src JOIN fl b ON b.cell = nb.dst),
lw AS (SELECT src, FIRST(dst ORDER BY drop DESC, dst) AS dst FROM dn WHERE drop > 0 GROUP BY src UNION ALL SELECT cell, cell FROM bs WHERE cell NOT IN (SELECT src FROM dn WHERE drop > 0)),
fs(cell, steps) USING KEY (cell) AS (SELECT src, 0 FROM lw UNION SELECT dn.dst, MIN(fs.steps) + 1 FROM fs JOIN dn ON dn.src = fs.cell AND la = lb LEFT JOIN recurring.fs o ON o.cell = dn.dst WHERE o.steps IS NULL GROUP BY dn.dst),
fd AS (SELECT src, dst FROM lw UNION ALL SELECT dn.src, MIN(dn.dst) FROM dn JOIN fs a ON a.cell = dn.src JOIN fs b ON b.cell = dn.dst WHERE la = lb AND b.steps = a.steps - 1 AND dn.src NOT IN (SELECT src FROM lw) GROUP BY dn.src)"""

_SIDES = "d(k, ar, ac, ox, oy, br, bc) AS (VALUES (0, 0, 1, -1, 0, 0, 0), (1, 1, 0, 0, 1, 0, 1), (2, 0, -1, 1, 0, 1, 1), (3, -1, 0, 0, -1, 1, 0))"

ORACLES = {
    # Edges clockwise around their cell; each is followed by a turn to the right where there is one.
    "mask_rings": f"""WITH RECURSIVE c AS (SELECT row_i AS r, col_i AS c, basin_id AS label FROM ({sql.CELLS}) k WHERE z IS NOT NULL), {_SIDES},
e AS (SELECT c.label, (c.r*100 + c.c)*4 + k AS edge, c.r + br AS y, c.c + bc AS x, CASE WHEN a.label IS NULL THEN (c.r*100 + c.c)*4 + (k + 1) % 4 WHEN g.label IS NULL THEN (a.r*100 + a.c)*4 + k ELSE (g.r*100 + g.c)*4 + (k + 3) % 4 END AS nxt
  FROM c CROSS JOIN d LEFT JOIN c o ON o.r = c.r + ox AND o.c = c.c + oy AND o.label = c.label LEFT JOIN c a ON a.r = c.r + ar AND a.c = c.c + ac AND a.label = c.label
  LEFT JOIN c g ON g.r = c.r + ar + ox AND g.c = c.c + ac + oy AND g.label = c.label WHERE o.label IS NULL),
w AS (SELECT e.edge AS origin, e.label, e.nxt AS here, CAST(1 AS BIGINT) AS n, e.x*f.y - f.x*e.y AS s FROM e JOIN e f ON f.edge = e.nxt
  UNION ALL SELECT origin, w.label, e.nxt, n + 1, s + e.x*f.y - f.x*e.y FROM w JOIN e ON e.edge = w.here JOIN e f ON f.edge = e.nxt WHERE w.here > origin)
SELECT label, origin AS ring, n AS n_corners, abs(s)/2.0::DOUBLE AS area, s < 0 AS hole FROM w WHERE here = origin""",
    "components": f"""WITH RECURSIVE {_Q}, c AS (SELECT row_i*2147483648 + col_i AS cell, row_i, col_i, cluster FROM q),
nb AS (SELECT a.cell AS a, b.cell AS b FROM c a JOIN c b ON a.cluster = b.cluster AND abs(a.row_i - b.row_i) + abs(a.col_i - b.col_i) = 1 AND a.row_i BETWEEN b.row_i - 1 AND b.row_i + 1 AND b.col_i IN (a.col_i - 1, a.col_i, a.col_i + 1)),
p(cell, part) USING KEY (cell) AS (SELECT cell, cell FROM c UNION SELECT nb.b, MIN(p.part) FROM p JOIN nb ON nb.a = p.cell JOIN recurring.p o ON o.cell = nb.b WHERE p.part < o.part GROUP BY nb.b)
SELECT part, cluster, COUNT(*) AS n FROM p JOIN c USING (cell) GROUP BY part, cluster""",
    "flow_from_dem": f"WITH RECURSIVE {_DEM} SELECT src, dst, round(level, 6) AS level FROM fd JOIN fl ON fl.cell = fd.src",
    "fac_from_dem": f"""WITH RECURSIVE {_DEM}, wk(origin, node) AS (SELECT src, src FROM fd UNION ALL SELECT origin, fd.dst FROM wk JOIN fd ON wk.node = fd.src WHERE fd.dst <> fd.src)
SELECT node AS src, CAST(COUNT(*) AS DOUBLE) AS facc FROM wk GROUP BY node""",
    "d8_accumulation_gaps": f"""WITH RECURSIVE {_F}, th AS (SELECT row_i*100 + col_i AS src FROM ({sql.CELLS}) k WHERE z IS NOT NULL), h AS (SELECT f.src, f.dst FROM f JOIN th USING (src)),
wk(origin, node) AS (SELECT src, src FROM h UNION ALL SELECT origin, h.dst FROM wk JOIN h ON wk.node = h.src WHERE h.dst <> h.src AND h.dst IN (SELECT src FROM th))
SELECT node AS src, CAST(COUNT(*) AS DOUBLE) AS facc FROM wk GROUP BY node""",
    "d8_encoding": "SELECT 'grass' AS raster, 'grass' AS encoding UNION ALL SELECT 'esri', 'esri' UNION ALL SELECT 'saga', 'saga' UNION ALL SELECT 'wrong', 'error'",
    "d8_downstream": f"WITH {_F} SELECT src, dst FROM f",
    "d8_confluences": f"""WITH {_F}, {_V}, k AS (SELECT f.src, f.dst, v.facc, COUNT(*) OVER (PARTITION BY f.dst) AS n_in, ROW_NUMBER() OVER (PARTITION BY f.dst ORDER BY v.facc DESC, f.src) = 1 AS main_stem
FROM f JOIN v ON f.src = v.src WHERE f.src <> f.dst) SELECT * FROM k WHERE n_in >= 2""",
    "d8_accumulation": f"""WITH RECURSIVE {_F}, wk(origin, node) AS (SELECT src, src FROM f UNION ALL SELECT origin, f.dst FROM wk JOIN f ON wk.node = f.src WHERE f.dst <> f.src)
SELECT node AS src, CAST(COUNT(*) AS DOUBLE) AS facc FROM wk GROUP BY node""",
    "d8_path": f"""WITH RECURSIVE {_F}, wk(node, step) AS (SELECT CAST(371 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT f.dst, step + 1 FROM wk JOIN f ON wk.node = f.src WHERE f.dst <> f.src)
SELECT node, step FROM wk""",
    "d8_labels": f"WITH RECURSIVE {_F}, {_SEEDS}, {_WALK} SELECT node, label FROM lb",
    "d8_trunk_labels": f"""WITH RECURSIVE {_F}, tk(node) AS (SELECT CAST(371 AS BIGINT) UNION ALL SELECT f.dst FROM tk JOIN f ON tk.node = f.src WHERE f.dst <> f.src),
s0 AS (SELECT src AS node, src//371 + 1 AS label FROM f0 WHERE src % 371 = 0),
sd AS (SELECT node, MAX(label) AS label FROM (SELECT node, CASE WHEN label > 2 THEN label ELSE 0 END AS label FROM s0 WHERE node IN (SELECT node FROM tk) UNION ALL SELECT node, label FROM s0 WHERE node NOT IN (SELECT node FROM tk)
  UNION ALL SELECT node, 2 FROM tk) u GROUP BY node), {_WALK} SELECT node, label FROM lb""",
    "subbasin_stats": f"""WITH RECURSIVE {_F}, {_V}, {_SEEDS}, {_WALK},
g AS (SELECT label AS label_id, COUNT(*) AS n_pixels, FIRST(node ORDER BY facc DESC, node) AS cell FROM lb JOIN v ON v.src = lb.node WHERE label > 0 GROUP BY label HAVING COUNT(*) >= 50)
SELECT label_id, n_pixels, round(n_pixels*100.0, 1)::DOUBLE AS area_m2, round(n_pixels*100.0/1e6, 4)::DOUBLE AS area_km2, cell//100 AS outlet_row, cell%100 AS outlet_col,
round((cell%100 + 0.5)*10.0, 4)::DOUBLE AS outlet_x, round(1000.0 - (cell//100 + 0.5)*10.0, 4)::DOUBLE AS outlet_y, ROW_NUMBER() OVER (ORDER BY n_pixels DESC, label_id) AS rank FROM g""",
    "outlet_auto": f"""WITH {_V}, k AS (SELECT src//100 AS row_i, src%100 AS col_i, facc, src FROM v), mx AS (SELECT MAX(src)//100 + 1 AS n FROM v)
SELECT row_i, col_i, facc FROM k, mx WHERE n <= 40 OR (row_i BETWEEN 20 AND n - 21 AND col_i BETWEEN 20 AND 79) ORDER BY facc DESC, src LIMIT 1""",
    "outlet_snap": f"""WITH {_V}, p AS (SELECT c_custkey AS fid, c_custkey//100 AS r, c_custkey%100 AS c FROM customer),
k AS (SELECT fid, v.src, ROW_NUMBER() OVER (PARTITION BY fid ORDER BY v.facc DESC, v.src) AS rn FROM p JOIN v ON abs(v.src//100 - r) <= 25 AND abs(v.src%100 - c) <= 25)
SELECT fid, src//100 AS row_i, src%100 AS col_i FROM k WHERE rn = 1""",
    "mask_edges": f"""WITH c AS (SELECT row_i, col_i, basin_id AS label FROM ({sql.CELLS}) k WHERE z IS NOT NULL),
e AS (SELECT label, row_i AS r0, col_i AS c0, row_i AS r1, col_i+1 AS c1 FROM c UNION ALL SELECT label, row_i+1, col_i, row_i+1, col_i+1 FROM c
  UNION ALL SELECT label, row_i, col_i, row_i+1, col_i FROM c UNION ALL SELECT label, row_i, col_i+1, row_i+1, col_i+1 FROM c),
o AS (SELECT label, r0, c0, r1, c1 FROM e GROUP BY ALL HAVING COUNT(*) % 2 = 1)
SELECT label, COUNT(*) AS n_edges, CAST(SUM(r0+r1+c0+c1) AS BIGINT) AS checksum FROM o GROUP BY label""",
    "stream_downhill": f"""WITH s AS (SELECT *, CASE WHEN seg_id % 3 <> 0 THEN seg_id*1.0::DOUBLE END AS z_start, CAST((seg_id % 50)*2.0 AS DOUBLE) AS z_end FROM ({sql.SEGMENTS}) q),
t AS (SELECT *, coalesce(z_start, -9999) < coalesce(z_end, -9999) AS turned FROM s)
SELECT basin_id, seg_id, CASE WHEN turned THEN end_x ELSE start_x END AS start_x, CASE WHEN turned THEN end_y ELSE start_y END AS start_y, CASE WHEN turned THEN start_x ELSE end_x END AS end_x,
CASE WHEN turned THEN start_y ELSE end_y END AS end_y, CASE WHEN turned THEN z_end ELSE z_start END AS z_start, CASE WHEN turned THEN z_start ELSE z_end END AS z_end, turned FROM t""",
    "snap_join": f"WITH {_SNAP} SELECT * FROM ln",
    "river_weights": f"WITH RECURSIVE {_WEIGHT} SELECT basin_id, seg_id, round(weight, 2) AS weight FROM wt",
    "main_river": f"""WITH RECURSIVE {_WEIGHT}, ot AS (SELECT basin_id, seg_id, weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY basin_id ORDER BY weight DESC, seg_id) AS rn FROM wt) k WHERE rn = 1),
nx AS (SELECT basin_id, seg_id, up_seg_id FROM (SELECT ln.*, ROW_NUMBER() OVER (PARTITION BY ln.basin_id, ln.seg_id ORDER BY weight DESC, up_seg_id) AS rn FROM ln JOIN wt ON wt.basin_id = ln.basin_id AND wt.seg_id = ln.up_seg_id) k WHERE rn = 1),
rv(basin_id, place, seg_id, length_m) AS (SELECT basin_id, CAST(0 AS BIGINT), seg_id, weight FROM ot UNION ALL SELECT rv.basin_id, place + 1, nx.up_seg_id, length_m FROM rv JOIN nx ON nx.basin_id = rv.basin_id AND nx.seg_id = rv.seg_id)
SELECT basin_id, place, seg_id, round(length_m, 2) AS length_m FROM rv""",
    "stream_clip": f"""WITH l AS (SELECT fid*1000 + vidx AS seg_id, x AS x1, y AS y1, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2 FROM ({sql.LINES}) q WINDOW w AS (PARTITION BY fid ORDER BY vidx)),
b AS ({sql.BASINS}), m AS (SELECT *, x2-x1 AS dx, y2-y1 AS dy FROM l, b WHERE x2 IS NOT NULL),
t AS (SELECT *, GREATEST(0, CASE WHEN dx <> 0 THEN LEAST((x_min-x1)/dx, (x_max-x1)/dx) ELSE 0 END, CASE WHEN dy <> 0 THEN LEAST((y_min-y1)/dy, (y_max-y1)/dy) ELSE 0 END) AS t0,
  LEAST(1, CASE WHEN dx <> 0 THEN GREATEST((x_min-x1)/dx, (x_max-x1)/dx) ELSE 1 END, CASE WHEN dy <> 0 THEN GREATEST((y_min-y1)/dy, (y_max-y1)/dy) ELSE 1 END) AS t1
  FROM m WHERE (dx <> 0 OR x1 BETWEEN x_min AND x_max) AND (dy <> 0 OR y1 BETWEEN y_min AND y_max))
SELECT fid, COUNT(*) AS n, round(SUM(sqrt(pow((t1-t0)*dx, 2) + pow((t1-t0)*dy, 2))), 3) AS total FROM t WHERE t0 < t1 GROUP BY fid""",
    "kmeans_assign": f"""WITH d AS (SELECT r, g, b, {', '.join(f'pow(r-{c[0]}, 2)+pow(g-{c[1]}, 2)+pow(b-{c[2]}, 2) AS d{i}' for i, c in enumerate(CENTRES))} FROM ({sql.PIXELS}) p)
SELECT CAST(CASE {_DIST} END AS INTEGER) AS cluster, round(AVG(r), 6) AS r, round(AVG(g), 6) AS g, round(AVG(b), 6) AS b, COUNT(*) AS n FROM d GROUP BY 1""",
    "median_filter": f"""WITH {_Q}, mx AS (SELECT MAX(row_i) AS last FROM q), n AS (SELECT q.row_i, q.col_i, CASE WHEN q.row_i + dr < 0 THEN 0 WHEN q.row_i + dr > last THEN last ELSE q.row_i + dr END AS r2,
CASE WHEN q.col_i + dc < 0 THEN 0 WHEN q.col_i + dc > 99 THEN 99 ELSE q.col_i + dc END AS c2 FROM q, mx, (SELECT unnest([-1, 0, 1]) AS dr) a, (SELECT unnest([-1, 0, 1]) AS dc) b)
SELECT n.row_i, n.col_i, list_sort(list(q.cluster))[5] AS cluster FROM n JOIN q ON q.row_i = n.r2 AND q.col_i = n.c2 GROUP BY n.row_i, n.col_i""",
    "hex_colours": f"SELECT row_i, col_i, '#' || printf('%02x', r) || printf('%02x', g) || printf('%02x', b) AS hex_color FROM ({sql.PIXELS}) p",
}
