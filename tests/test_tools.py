"""Whole tools on small closed cases, sinks by round trip, and the raster source against bytes written here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import checks, clip, filling, grid, mapunits, outlets, outlines, tables, tools
from thalweg.sources import geotiff, sinks

META = grid.GridMeta(0.0, 10.0, 100.0, -10.0, 10, 10)


@pytest.fixture(scope="module")
def slope(spark):
    """A plane that falls to the south."""
    return spark.range(100).select(F.floor(F.col("id") / 10).alias("row_i"), (F.col("id") % 10).alias("col_i"), (F.lit(100.0) - F.floor(F.col("id") / 10) * 10).alias("z"))


def line(spark, *lines):
    rows = [(fid, i, float(x), float(y)) for fid, points in lines for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "fid long, vidx long, x double, y double")


def ring(spark, *rings):
    rows = [(fid, part, no, i, float(x), float(y)) for fid, part, no, points in rings for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "fid long, part int, ring int, vidx long, x double, y double")


SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]


def test_main_river_is_clipped_turned_and_traced(spark, slope):
    """A trunk drawn uphill, a long and a short tributary, and a basin without a stream."""
    streams = line(spark, (1, [(50, -20), (50, 40)]), (2, [(50, 40), (20, 95)]), (3, [(60, 50), (50, 40)]))
    basins = ring(spark, (7, 0, 0, SQUARE), (8, 0, 0, [(x + 500, y) for x, y in SQUARE]))
    found = tools.main_rivers(streams, basins, slope, META, cell=50.0)
    got = [(round(r["x"], 6), round(r["y"], 6)) for r in found.vertices.orderBy("fid", "vidx").collect()]
    assert got == [(20.0, 95.0), (50.0, 40.0), (50.0, 0.0)]
    (length,) = found.lengths.collect()
    assert length["n_segments"] == 3 and abs(length["length_m"] - (40 + np.hypot(30, 55))) < 0.01
    assert [tuple(r) for r in found.skipped.collect()] == [(8, "no stream found in basin")]


def test_clip_follows_a_concave_polygon(spark):
    from thalweg.operators import clip

    notch = [(0, 0), (100, 0), (100, 100), (60, 100), (60, 40), (40, 40), (40, 100), (0, 100), (0, 0)]
    found = clip.lines_in_polygons(line(spark, (1, [(-10, 70), (110, 70)])), ring(spark, (7, 0, 0, notch)), 30.0)
    segments, vertices = clip.parts(found)
    assert sorted((round(r["start_x"], 6), round(r["end_x"], 6)) for r in segments.collect()) == [(0.0, 40.0), (60.0, 100.0)]
    assert vertices.count() == 4


def test_fluvial_tool_runs_from_rasters(spark, slope):
    river = line(spark, (7, [(50, 99), (50, 1)]))
    facc = slope.select("row_i", "col_i", (F.col("row_i") + 1.0).alias("facc"))
    found = tools.steepness(river, slope, facc, META)
    n = found.profile.count()
    assert n == 33 and found.summary.count() == 1
    layers = tables.river_layers(
        river, found.profile, spark.createDataFrame([("R", 7, 0.1, 1.0, 1.0, 0)], "label string, fid long, length_km double, ksn_mean double, chi_max double, n_knickpoints long"), found.segments,
        tables.with_distance(found.knickpoints, found.profile), spark.createDataFrame([(7, "R")], "basin_id long, label string"),
    )
    assert {k: v.count() > 0 for k, v in layers.items() if k != "knickpoints"} == {"main_rivers": True, "ksn_segments": True, "profile_points": True}
    assert layers["main_rivers"].first()["wkt"] == "LINESTRING (50.0 99.0, 50.0 1.0)"
    assert layers["profile_points"].where("wkt is null").count() == 0


def test_polygons_of_labels_have_holes(spark):
    labels = spark.range(36).select(F.floor(F.col("id") / 6).alias("row_i"), (F.col("id") % 6).alias("col_i")).withColumn("label", F.when(F.col("row_i").between(2, 3) & F.col("col_i").between(2, 3), 2).otherwise(1))
    found = tools.polygons(labels, META)
    rings = {(r["label"], r["ring"]): r["n"] for r in found.groupBy("label", "ring").agg(F.countDistinct("x", "y").alias("n")).collect()}
    assert set(rings) == {(1, 0), (1, 1), (2, 0)}
    area = {r["fid"]: r["area_m2"] for r in grid.ring_areas(found.withColumnRenamed("label", "fid")).collect()}
    assert area == {1: 3200.0, 2: 400.0}
    assert tools.polygons(labels, META, holes=False).select("label", "ring").distinct().count() == 2
    wkt = tables.polygon_wkt(found.withColumnRenamed("label", "fid")).where("fid = 2").first()["wkt"]
    assert wkt.startswith("MULTIPOLYGON (((") and wkt.endswith(")))")


def test_map_units_end_to_end(spark):
    pixels = spark.range(100).select(F.floor(F.col("id") / 10).alias("row_i"), (F.col("id") % 10).alias("col_i")).withColumn("dark", F.col("col_i") < 5)
    rgb = pixels.select("row_i", "col_i", *[F.when(F.col("dark"), F.lit(10)).otherwise(F.lit(200)).cast("long").alias(c) for c in "rgb"])
    outlines, colours = tools.map_units(rgb, META, k=2, smooth=3, sieve=4)
    assert outlines.select("cluster_id", "part").distinct().count() == 2
    named = tables.unit_colours(outlines.withColumnRenamed("cluster_id", "cluster"), colours)
    assert {r["hex_color"] for r in named.collect()} == {"#0a0a0a", "#c8c8c8"}
    masked, _ = tools.map_units(rgb, META, k=2, smooth=0, sieve=0, mask=ring(spark, (1, 0, 0, [(0, 0), (40, 0), (40, 100), (0, 100), (0, 0)])))
    assert masked.agg(F.max("x")).first()[0] == 40.0


def test_clusters_of_an_image_with_gaps(spark):
    pixels = spark.range(60).where("id % 3 <> 1").select(F.floor(F.col("id") / 6).alias("row_i"), (F.col("id") % 6).alias("col_i"), *[(F.col("id") * k % 256).alias(c) for c, k in (("r", 7), ("g", 11), ("b", 13))])
    labels, centres = mapunits.kmeans(pixels, 3, 6)
    assert len(centres) == 3 and labels.count() == 40
    flat = np.array([(r["r"], r["g"], r["b"]) for r in pixels.orderBy("row_i", "col_i").collect()], float)
    rng = np.random.RandomState(42)
    centre = flat[rng.choice(len(flat), 3, replace=False)]
    for _ in range(50):
        near = ((flat[:, None] - centre) ** 2).sum(2).argmin(1)
        new = np.array([flat[near == i].mean(0) if (near == i).any() else flat[rng.randint(0, len(flat))] for i in range(3)])
        shift, centre = np.sqrt(((new - centre) ** 2).sum(1)).max(), new
        if shift < 1:
            break
    assert centres == [tuple(int(v) for v in c) for c in centre]


def test_palette_and_bands(spark):
    palette = spark.createDataFrame([(i, i, 2, 3) for i in range(300)], "index int, r long, g long, b long")
    got = mapunits.decoded(spark.createDataFrame([(0, 0, 299), (0, 1, 400)], "row_i long, col_i long, index int"), palette).orderBy("col_i").collect()
    assert [(r["r"], r["g"], r["b"]) for r in got] == [(299, 2, 3), (0, 0, 0)]
    bands = spark.createDataFrame([(0, 0, 1, 2, 3)], "row_i long, col_i long, b1 long, b2 long, b3 long")
    assert [tuple(mapunits.rgb(bands, n).first())[2:] for n in (1, 2, 3)] == [(1, 1, 1), (1, 2, 0), (1, 2, 3)]


def test_outlet_of_the_user(spark):
    facc = spark.range(100).select(F.col("id").alias("src"), F.when(F.col("id") == 55, 50.0).otherwise(1.0).alias("facc"))
    points = spark.createDataFrame([(1, 41.0, 59.0), (2, 5.0, 5.0)], "fid long, x double, y double")
    where, warned = tools.resolved_outlet(points, facc, META)
    assert tuple(where.first()) == (5, 5) and warned.count() == 1
    where, warned = tools.resolved_outlet(spark.createDataFrame([(1, -500.0, 0.0)], "fid long, x double, y double"), facc, META)
    assert where.count() == 0 and warned.first()["message"] == "the outlet lies off the grid"
    assert tuple(tools.resolved_outlet(None, facc, META)[0].first()) == (5, 5)


def test_problems_of_inputs(spark, slope):
    lines = line(spark, (1, [(0, 0), (1, 1)]))
    assert checks.problems("swath", dem=slope, lines=lines) == []
    assert checks.problems("swath", dem=slope.drop("z"), lines=lines.limit(0)) == ["dem: no column z", "lines: no row"]
    assert checks.problems("rose") == ["lines: missing"]
    with pytest.raises(ValueError):
        checks.problems("openness")
    both = lines.unionByName(line(spark, (2, SQUARE), (3, [(0, 0)])))
    assert [sorted(r["fid"] for r in checks.of_type(both, k).select("fid").distinct().collect()) for k in ("point", "line", "polygon")] == [[3], [1], [2]]


def test_sheets_documents_and_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é;x", 1.5), (2, None, float("nan"))], "a int, b string, c double").coalesce(1)
    sinks.write_sheet(df, str(tmp_path / "s.csv"), ";")
    assert (tmp_path / "s.csv").read_bytes() == "﻿sep=;\na;b;c\r\n1;\"é;x\";1.5\r\n2;;nan\r\n".encode()
    sinks.write_document(df, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text(encoding="utf-8")) == [{"a": 1, "b": "é;x", "c": 1.5}, {"a": 2, "b": None, "c": None}]
    sinks.write_layers({"one": df, "two": df.select("a")}, str(tmp_path / "out"))
    sinks.write_layers({"two": df.select("a").limit(1)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/one")).count() == 2 and spark.read.parquet(str(tmp_path / "out/two")).count() == 1
    with pytest.raises(ValueError):
        tables.measure_pair(df, "maxC", "maxC")


def tiff(path, values, order="<", compression=1, predictor=1, rows=3, tile=None, nodata=None, planar=False, crs=None):
    """A small GeoTIFF writer, for the reader's round trip."""
    values = np.atleast_3d(values)
    h, w, bands = values.shape
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    if tile:
        blocks = []
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                b = np.zeros((tile, tile, bands), values.dtype)
                part = values[r : r + tile, c : c + tile]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b)
    else:
        blocks = [values[r : r + rows] for r in range(0, h, rows)]
    if planar:  # all blocks of a band, then those of the next
        blocks = [b[:, :, k : k + 1] for k in range(bands) for b in blocks]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])).astype(b.dtype) for b in blocks]
    raw = [b.astype(b.dtype.newbyteorder(order)).tobytes() for b in blocks]
    raw = [zlib.compress(x) for x in raw] if compression == 8 else raw
    data, offsets = b"", []
    for x in raw:
        offsets.append(8 + len(data))
        data += x
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [values.dtype.itemsize * 8] * bands), (259, "H", [compression]), (277, "H", [bands]), (284, "H", [2 if planar else 1]), (317, "H", [predictor]), (339, "H", [kind] * bands),
            (33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 500.0, 900.0, 0.0])]
    tags += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", offsets), (325, "I", [len(x) for x in raw])] if tile else [(273, "I", offsets), (278, "I", [rows]), (279, "I", [len(x) for x in raw])]
    if nodata is not None:
        tags.append((42113, "s", nodata.encode() + b"\0"))
    if crs is not None:
        tags.append((34735, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, crs]))
    at = 8 + len(data)
    extra, entries = b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, code, v in sorted(tags):
        body = v if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
        kind_no = {"H": 3, "I": 4, "d": 12, "s": 2}[code]
        if len(body) > 4:
            entries += struct.pack(order + "HHII", tag, kind_no, len(v), base + len(extra))
            extra += body
        else:
            entries += struct.pack(order + "HHI", tag, kind_no, len(v)) + body.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    path.write_bytes(head + data + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + extra)


@pytest.mark.parametrize(
    "dtype,options",
    [("f4", {"nodata": "-9999"}), ("i2", {"order": ">"}), ("u1", {"compression": 8, "predictor": 2}), ("f8", {"tile": 16, "compression": 8}), ("u2", {"tile": 16, "predictor": 2, "order": ">"})],
)
def test_geotiff_round_trip(spark, tmp_path, dtype, options):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 200, (21, 18)).astype(dtype)
    if "nodata" in options:
        values[3, 4] = -9999
    path = tmp_path / "a.tif"
    tiff(path, values, **options)
    cells, meta = geotiff.read(spark, str(path))
    got = {(r["row_i"], r["col_i"]): r["z"] for r in cells.collect()}
    assert got == {(r, c): None if values[r, c] == -9999 else float(values[r, c]) for r in range(21) for c in range(18)}
    assert (meta.x0, meta.px_w, meta.y0, meta.px_h, meta.n_rows, meta.n_cols) == (500.0, 10.0, 900.0, -10.0, 21, 18)


def test_geotiff_bands_and_errors(spark, tmp_path):
    values = np.arange(4 * 5 * 3, dtype="u1").reshape(4, 5, 3)
    tiff(tmp_path / "rgb.tif", values)
    cells, _ = geotiff.read(spark, str(tmp_path / "rgb.tif"), 2)
    assert cells.where("row_i = 2 and col_i = 1").first()["z"] == values[2, 1, 1]
    (tmp_path / "no.tif").write_bytes(b"not a tiff")
    with pytest.raises(ValueError):
        geotiff.layout(str(tmp_path / "no.tif"))
    tiff(tmp_path / "lzw.tif", values, compression=5)
    with pytest.raises(ValueError, match="compression"):
        geotiff.layout(str(tmp_path / "lzw.tif"))


def blocks_read(path, filters=(), **options):
    """Numbers of the blocks that a scan would read."""
    reader = geotiff._Pushed(str(path), 2, geotiff.Choice.of({k: str(v) for k, v in options.items()}))
    assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark tests the rows itself
    return [n for p in reader.partitions() for n in p.numbers]


def test_geotiff_reads_only_the_blocks_it_needs(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    values = np.arange(40 * 50 * 3, dtype="i4").reshape(40, 50, 3)
    path = tmp_path / "tiles.tif"
    tiff(path, values, tile=16, planar=True, crs=32632)  # 3 x 4 tiles in each of three planes
    assert len(blocks_read(path)) == 36
    assert blocks_read(path, min_band=2, max_band=2) == list(range(12, 24))
    assert blocks_read(path, min_band=1, max_band=1, min_row_i=15, max_row_i=16, min_col_i=32, max_col_i=32) == [2, 6]
    assert blocks_read(path, [EqualTo(("band",), 3), GreaterThan(("row_i",), 31), LessThanOrEqual(("col_i",), 15)]) == [32]
    assert blocks_read(path, [In(("row_i",), (1, 3)), EqualTo(("v",), 5.0), EqualTo(("band",), 1)]) == [0, 1, 2, 3]
    assert blocks_read(path, [EqualTo(("row_i",), 400)]) == []
    for place in (str(path), path.as_uri()):
        cells, meta = geotiff.read(spark, place, 2, (15, 17, 30, 33))
        got = {(r["row_i"], r["col_i"]): r["z"] for r in cells.collect()}
        assert got == {(r, c): float(values[r, c, 1]) for r in range(15, 18) for c in range(30, 34)} and meta.crs == 32632
    assert geotiff.read(spark, str(path), 1, (100, 200, 0, 1))[0].count() == 0
    kept = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        whole = spark.read.format("geotiff").option("blocks", 1).option("push", "true").load(str(path))
        few = whole.where("band = 1 and row_i >= 32 and col_i < 3")
        assert few.rdd.getNumPartitions() == 1 and sorted(r["v"] for r in few.collect()) == sorted(values[32:, :3, 0].ravel().tolist())
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", kept)


@pytest.mark.parametrize("size,side", [(3, 5), (5, 6), (7, 64)])
def test_median_across_squares(spark, size, side):
    rng = np.random.default_rng(size)
    grid_ = rng.integers(0, 9, (13, 17))
    half = size // 2
    padded = np.pad(grid_, half, mode="symmetric")
    want = {(r, c): int(np.sort(padded[r : r + size, c : c + size].ravel())[size * size // 2]) for r in range(13) for c in range(17)}
    labels = spark.createDataFrame([(r, c, int(grid_[r, c])) for r in range(13) for c in range(17)], "row_i long, col_i long, cluster int")
    found = mapunits.median(labels, 13, 17, size, side=side)
    assert dict(found.dtypes)["cluster"] == "int"
    assert {(r["row_i"], r["col_i"]): r["cluster"] for r in found.collect()} == want


def test_tasks_of_a_walk_grow_with_its_steps(spark, monkeypatch):
    """Twenty rivers of two vertices make 300 steps each: few vertices, but many tasks' worth of steps."""
    from thalweg.operators import sampling

    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("row_i"), (F.col("id") % 10).alias("col_i"), F.col("id").cast("double").alias("z"), F.lit(1.0).alias("facc"))
    rivers = line(spark, *[(fid, [(1, 99), (1, 98 - 0.01 * fid)] * 150) for fid in range(20)])
    monkeypatch.setattr(sampling, "STEPS_A_TASK", 100)
    found = sampling.cell_by_cell(rivers, cells.select("row_i", "col_i", "z"), cells.select("row_i", "col_i", "facc"), META)
    assert found.rdd.getNumPartitions() >= 20 * 299 / 100
    assert found.groupBy("basin_id").agg(F.count("*").alias("n"), F.max("idx").alias("last")).where("n = 299 and last = 298").count() == 20


def test_edges_and_links_are_not_broadcast(spark):
    """Edges grow when they are dealt to squares and bands, links of regions with the grid."""
    rings = spark.createDataFrame([(i, 0, 0, k, 9.0 * i + x, y) for i in range(20) for k, (x, y) in enumerate([(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)])], "fid long, part int, ring int, vidx long, x double, y double")
    lines = spark.createDataFrame([(100 + i, k, 9.0 * i + x, 4.0) for i in range(20) for k, x in enumerate((-0.5, 2.0, 8.5))], "fid long, vidx long, x double, y double")
    pieces = clip.lines_in_polygons(lines, rings, 4.0)
    assert sorted((r["fid"], r["line"], r["x1"] - 9.0 * r["fid"], r["x2"] - 9.0 * r["fid"]) for r in pieces.collect()) == sorted((i, 100 + i, a, b) for i in range(20) for a, b in ((0.0, 2.0), (2.0, 8.0)))
    links = spark.createDataFrame([(i, i + 1, float(i % 7)) for i in range(1, 200)] + [(1, filling.OUTSIDE, 0.0)], "a long, b long, level double")
    roots = filling._roots(links.select(F.col("b").alias("region"), F.col("a").alias("root"), F.lit(0.0).alias("took")), 64)
    assert filling.spill_levels(links).count() == 200
    at = roots.select(F.col("region").alias("root"), F.lit(1).alias("n"))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (pieces, roots.join(at, "root"))]
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_rows_of_polygons_are_not_broadcast(spark):
    """Areas, integrals, names and faults have a row for each polygon."""
    corners = [(0.0, 0.0), (8.0, 0.0), (8.0, -8.0), (0.0, -8.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(i, f"B{i}", 0, 0, k, 9.0 * i + x, y) for i in range(6) for k, (x, y) in enumerate(corners)], "fid long, label string, part int, ring int, vidx long, x double, y double")
    dem = spark.createDataFrame([(r, c, float(r * c)) for r in range(8) for c in range(40)], "row_i long, col_i long, z double")
    found, _, gone = tools.hypsometry_of(dem, rings, grid.GridMeta(0.0, 1.0, 0.0, -1.0, 8, 40), "label", cell=9.0)
    assert sorted((r["label"], r["n_cells"]) for r in found.collect()) == [(f"B{i}", 64) for i in range(4)] + [("B4", 32)]
    assert {r["fid"] for r in gone.collect()} == {5}
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in (found, gone))


def test_sides_of_rings_are_not_broadcast(spark):
    """Sides of cells grow with the outlines, and so do the rings that close in a tile."""
    cells = spark.createDataFrame([(r, c, r // 2) for r in range(6) for c in range(6)], "row_i long, col_i long, label int")
    found = outlines.rings(cells, 6, side=8)
    assert found.count() == 3 * 17
    assert "BroadcastHashJoin [first" not in found._jdf.queryExecution().executedPlan().toString()


def test_confluences_are_sorted_once(spark):
    """Each lesser inflow of a confluence gets its stem without a second pass over the grid."""
    flow = spark.createDataFrame([(i, 10 * (i // 3) + 100) for i in range(30)], "src long, dst long")
    facc = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "src long, facc double")
    got = outlets.lesser_inflows(flow, facc)
    assert {(r["src"], r["stem"], r["facc"], r["stem_facc"]) for r in got.collect()} == {(i, i // 3 * 3 + 2, float(i % 3), 2.0) for i in range(30) if i % 3 < 2}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_skipped_rivers_need_no_accumulation(spark, slope, monkeypatch):
    """What is skipped is known from elevations: a driver that only asks for that does not plan the grid's filling; the rest of the tool still gets it."""
    short = slope.withColumn("z", F.when(F.col("col_i") < 8, F.col("z")))
    streams = line(spark, (1, [(25, 95), (25, 5)]), (2, [(85, 95), (85, 5)]))
    basins = ring(spark, *[(fid, 0, 0, [(x, 0), (x + 40, 0), (x + 40, 100), (x, 100), (x, 0)]) for fid, x in ((1, 5), (2, 55), (3, 200))])
    calls, whole = [], tools.accumulation_of
    monkeypatch.setattr(tools, "accumulation_of", lambda *a, **k: calls.append(1) or whole(*a, **k))
    found = tools.fluvial_of(streams, basins, short, META, cell=50.0)
    expected = {(2, "Basin_2", "too few points with an elevation"), (3, "Basin_3", "no stream found in basin")}
    assert {tuple(r) for r in found.skipped.select("fid", "label", "reason").collect()} == expected and not calls
    assert [r["basin_id"] for r in found.found.summary.collect()] == [1] and len(calls) == 1
    assert found.found.segments.count() >= 1 and len(calls) == 1
    assert {tuple(r) for r in found.skipped.select("fid", "label", "reason").collect()} == expected
    assert found.messages == ["accumulation computed from the elevations"]
