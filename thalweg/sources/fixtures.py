"""Inputs of the tools as DataFrames, derived from the star-schema tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Georeference of the elevation grid.
X0, Y0, PIXEL_W, PIXEL_H, N_COLS = 0.0, 1000.0, 10.0, -10.0, 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elevation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_i, col_i, z, basin_id (F1)."""
    return read(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / N_COLS).alias("row_i"),
        (F.col("o_orderkey") % N_COLS).alias("col_i"),
        F.expr(
            # Rounded as the SQL's engine does, by whole thousandths: at halves the decimal digits may say otherwise.
            "CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE ROUND((3000D - 2D * FLOOR(o_orderkey / 100)"
            " + 0.5D * ABS(o_orderkey % 100 - 50) + o_totalprice / 10000D) * 1000D) / 1000D END"
        ).alias("z"),
        F.expr("FLOOR(o_orderkey / 1500) * 4 + FLOOR((o_orderkey % 100) / 25)").cast("long").alias("basin_id"),
    )


def flow_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, row_i, col_i, fdir (F2)."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("src"),
        F.floor(F.col("o_orderkey") / N_COLS).alias("row_i"),
        (F.col("o_orderkey") % N_COLS).alias("col_i"),
        (5 + F.col("o_custkey") % 3).alias("fdir"),
    )


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf_dir, "events").withColumn("i", F.row_number().over(w) - 1)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, vidx, x, y (F3)."""
    return _steps(spark, sf_dir).select(
        F.col("user_id").alias("fid"),
        F.col("i").cast("long").alias("vidx"),
        ((F.col("event_id") * 37) % 1000).cast("double").alias("x"),
        (F.col("value") * 2).alias("y"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basin_id, idx, dist_m, elev, area_m2, area_raw (F4)."""
    i = F.col("i").cast("double")
    area = F.lit(900.0) * (i + 1) * (i + 1)
    return _steps(spark, sf_dir).select(
        F.col("user_id").alias("basin_id"),
        F.col("i").cast("long").alias("idx"),
        (F.lit(30.0) * i).alias("dist_m"),
        F.round(F.lit(2500.0) - 8 * i - 40 * F.log(1 + i) + F.col("value") / 100, 3).alias("elev"),
        area.alias("area_m2"),
        F.when(F.col("event_type") != "error", area).alias("area_raw"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_i, col_i, r, g, b (F5)."""
    return read(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / N_COLS).alias("row_i"),
        (F.col("o_orderkey") % N_COLS).alias("col_i"),
        ((F.col("o_custkey") * 7) % 256).cast("long").alias("r"),
        (F.floor("o_totalprice") % 256).cast("long").alias("g"),
        ((F.col("o_orderkey") * 13) % 256).cast("long").alias("b"),
    )


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, label, x_min, x_max, y_min, y_max (F6)."""
    ids = elevation_cells(spark, sf_dir).select("basin_id").distinct()
    left = (F.col("basin_id") % 4) * F.lit(250.0)
    top = F.lit(1000.0) - F.floor(F.col("basin_id") / 4) * F.lit(150.0)
    return ids.select(
        F.col("basin_id").alias("fid"),
        F.when(F.col("basin_id") % 10 == 9, F.lit("  ")).otherwise(F.concat(F.lit("BV "), F.col("basin_id").cast("string"))).alias("label"),
        left.alias("x_min"),
        (left + 250.0).alias("x_max"),
        (top - 150.0).alias("y_min"),
        top.alias("y_max"),
    )


def basin_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, label, part, ring, vidx, x, y: the rectangles as closed rings."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max"), corner("x_min", "y_min"))
    return basins(spark, sf_dir).select("fid", "label", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.posexplode(ring).alias("vidx", "p")).select(
        "fid", "label", "part", "ring", F.col("vidx").cast("long").alias("vidx"), "p.x", "p.y"
    )


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basin_id, seg_id, start_x, start_y, end_x, end_y, len_m (F7)."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    k, up = F.col("k"), F.floor((F.col("k") - 1) / 2)
    return read(spark, sf_dir, "customer").withColumn("k", (F.row_number().over(w) - 1).cast("long")).select(
        F.col("c_nationkey").cast("long").alias("basin_id"),
        k.alias("seg_id"),
        ((k % 97) * 10).cast("double").alias("start_x"),
        (F.floor(k / 97) * 10).cast("double").alias("start_y"),
        F.when(k == 0, F.lit(-500.0)).otherwise((up % 97) * 10 + F.lit(0.5)).cast("double").alias("end_x"),
        F.when(k == 0, F.lit(-500.0)).otherwise(F.floor(up / 97) * 10 + F.lit(0.5)).cast("double").alias("end_y"),
        (F.lit(100.0) + F.col("c_custkey") % 50).cast("double").alias("len_m"),
    )
