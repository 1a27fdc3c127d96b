"""Cells in polygons and statistics of groups, where size and rounding matter."""

from pyspark.sql import functions as F

from thalweg.operators import clip, grid, hypsometry, zones

META = grid.GridMeta(0.0, 1.0, 0.0, -1.0, 1000, 1000)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one_large_polygon(spark):
    corners = [(0.0, -900.0), (900.0, -900.0), (900.0, 0.0), (0.0, 0.0), (0.0, -900.0)]
    return spark.createDataFrame([(7, 0, 0, i, x, y) for i, (x, y) in enumerate(corners)], "fid long, part int, ring int, vidx long, x double, y double")


def every_cell(spark):
    return spark.range(1_000_000).select(F.floor(F.col("id") / 1000).alias("row_i"), (F.col("id") % 1000).alias("col_i"))


def test_cells_of_few_large_polygons_are_not_broadcast(spark):
    found = zones.cells_in_zones(every_cell(spark), one_large_polygon(spark), META).agg(F.count("*").alias("n"))
    assert found.collect()[0]["n"] == 810_000
    assert "BroadcastHashJoin" not in plan(found)


def test_group_sums_at_a_half_do_not_depend_on_their_last_bits(spark):
    """Twelve times 0.0375 is 0.45, but 0.4499999999999999 as a running sum of floats."""
    rows = spark.range(12).coalesce(1).select(F.lit(1).alias("group_no"), F.lit(0.5).alias("hi"), F.lit(0.0375).alias("area_km2"), F.lit(1e300).alias("relief"))
    (got,) = hypsometry.group_statistics(rows, "group_no").collect()
    assert got["area_total_km2"] == 0.5 and got["relief_mean"] > 9e299


def test_cells_in_a_large_mask_are_not_broadcast(spark):
    found = clip.cells_in_mask(every_cell(spark), one_large_polygon(spark), META).agg(F.count("*").alias("n"))
    assert found.collect()[0]["n"] == 810_000
    assert "BroadcastHashJoin" not in plan(found)
