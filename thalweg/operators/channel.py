"""Normalised channel profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(profile: DataFrame) -> DataFrame:
    """basin_id, idx, x, y, deviation from the straight line from source to mouth; flat profiles have no rows."""
    w = Window.partitionBy("basin_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d0, d1 = F.first("dist_m").over(w), F.last("dist_m").over(w)
    low, high = F.min("elev").over(w), F.max("elev").over(w)
    sized = profile.select("basin_id", "idx", "dist_m", "elev", d0.alias("d0"), (d1 - d0).alias("dd"), low.alias("low"), (high - low).alias("dz"))
    shaped = sized.where("dd > 1e-10 and dz > 1e-10").select("basin_id", "idx", ((F.col("dist_m") - F.col("d0")) / F.col("dd")).alias("x"), ((F.col("elev") - F.col("low")) / F.col("dz")).alias("y"))
    return shaped.withColumn("deviation", (1 - F.col("x")) - F.col("y"))


def skipped(profile: DataFrame, least_points: int = 5) -> DataFrame:
    """basin_id and reason of profiles too short or flat."""
    known = profile.groupBy("basin_id").agg(F.count("elev").alias("n"), (F.max("elev") - F.min("elev")).alias("dz"), (F.max("dist_m") - F.min("dist_m")).alias("dd"))
    return known.where((F.col("n") < least_points) | ~(F.col("dz") > 1e-10) | ~(F.col("dd") > 1e-10)).select("basin_id", F.lit("insufficient valid profile points").alias("reason"))


def metrics(points: DataFrame) -> DataFrame:
    """basin_id, max_c, dl, y_at_dl, diagonal_at_dl (null without a positive deviation) and concavity (%)."""
    w = Window.partitionBy("basin_id").orderBy("idx")
    step = (F.col("deviation") + F.lag("deviation").over(w)) / 2 * (F.col("x") - F.lag("x").over(w))
    best = F.max_by(F.struct("deviation", "x", "y"), F.when(F.col("deviation") > 0, F.struct("deviation", -F.col("idx"))))
    out = points.select("*", step.alias("s")).groupBy("basin_id").agg(best.alias("b"), F.max("deviation").alias("top"), F.sum("s").alias("area"))
    got = lambda c: F.when(F.col("top") > 0, F.round(c, 4))
    return out.select("basin_id", got(F.col("b.deviation")).alias("max_c"), got(F.col("b.x")).alias("dl"), got(F.col("b.y")).alias("y_at_dl"), got(1 - F.col("b.x")).alias("diagonal_at_dl"), F.round(F.col("area") / 0.5 * 100, 2).alias("concavity"))


def fleet(found: DataFrame) -> DataFrame:
    """Counts, and means over the values there are."""
    return found.agg(
        F.count("*").alias("n"), F.count("max_c").alias("n_max_c"), F.avg("max_c").alias("max_c_mean"), F.avg("dl").alias("dl_mean"), F.avg("concavity").alias("concavity_mean")
    )


def padded_range(found: DataFrame, column: str, share: float = 0.12) -> DataFrame:
    """low, high: the range of a column with ``share`` of it at both ends; 0.05 where it is nil."""
    pad = F.when(F.col("b") - F.col("a") == 0, F.lit(0.05)).otherwise((F.col("b") - F.col("a")) * share)
    return found.agg(F.min(column).alias("a"), F.max(column).alias("b")).select((F.col("a") - pad).alias("low"), (F.col("b") + pad).alias("high"))
