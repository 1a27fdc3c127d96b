"""Rose diagrams: directional histograms of line segments and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import polylines


def directions(vertices: DataFrame, densify: float = 0.0, min_length: float = 0.0, min_rectitude: float = 0.0, half: bool = False, axial: bool = True) -> DataFrame:
    """az, len of every measured segment; axial symmetry adds the opposite direction, a half rose folds to 180 degrees."""
    segs = polylines.densified(polylines.segments(polylines.keep_straight(vertices, min_rectitude), min_length), densify).select("az", "len")
    if half:
        return segs.withColumn("az", F.pmod("az", F.lit(180.0)))
    if not axial:
        return segs
    # One pass over the segments: both directions come from one row.
    return segs.select(F.explode(F.array(F.col("az"), F.pmod(F.col("az") + 180.0, F.lit(360.0)))).alias("az"), "len")


def histogram(found: DataFrame, n_sectors: int = 36, mode: str = "length", half: bool = False) -> DataFrame:
    """bin, center, value of every sector, empty ones too; mode: length, count or frequency (share of length, %)."""
    if mode not in ("length", "count", "frequency"):
        raise ValueError(f"unknown mode {mode}")
    width = (180.0 if half else 360.0) / n_sectors
    bin_of = F.least(F.floor(F.col("az") / width), F.lit(n_sectors - 1).cast("long"))
    sums = found.groupBy(bin_of.alias("bin")).agg(F.sum(F.lit(1.0) if mode == "count" else F.col("len")).alias("v"))
    every = found.sparkSession.range(n_sectors).withColumnRenamed("id", "bin")
    value = F.coalesce("v", F.lit(0.0))
    if mode == "frequency":
        # Over n_sectors rows at most: the total is of the sums, not of the segments.
        total = sums.agg(F.sum("v").alias("total"))
        sums = sums.crossJoin(F.broadcast(total)).select("bin", F.when(F.col("total") > 0, F.col("v") / F.col("total") * 100).otherwise(F.col("v")).alias("v"))
    return every.join(F.broadcast(sums), "bin", "left").select("bin", ((F.col("bin") + 0.5) * width).alias("center"), value.alias("value"))


def statistics(found: DataFrame, bins: DataFrame) -> DataFrame:
    """One row: dominant, secondary, mean, r, anisotropy, entropy, n, total_km.

    The secondary sector is the highest beside the dominant one and its two neighbours; the mean is
    null where the resultant length is practically zero.
    """
    circular = found.agg(
        (F.sum(F.sin(F.radians("az")) * F.col("len")) / F.sum("len")).alias("s"),
        (F.sum(F.cos(F.radians("az")) * F.col("len")) / F.sum("len")).alias("c"),
        F.count("*").alias("n"),
        (F.sum("len") / 1000).alias("total_km"),
    )
    top = bins.agg(F.max_by("bin", F.struct("value", -F.col("bin"))).alias("top"), F.count("*").alias("k"), F.sum("value").alias("total"), F.max("value").alias("most"))
    ranked = bins.crossJoin(F.broadcast(top))
    apart = F.pmod(F.col("bin") - F.col("top"), F.col("k"))
    masked = F.when(apart.isin(0, 1) | (apart == F.col("k") - 1), F.lit(0.0)).otherwise(F.col("value"))
    share = F.col("value") / F.nullif("total", F.lit(0.0))
    shape = ranked.agg(
        F.max(F.when(F.col("bin") == F.col("top"), F.col("center"))).alias("dominant"),
        F.max_by("center", F.struct(masked, -F.col("bin"))).alias("secondary"),
        (F.max("most") / F.nullif(F.max("total"), F.lit(0.0))).alias("anisotropy"),
        (-F.sum(F.when(F.col("value") > 0, share * F.log2(share)))).alias("entropy"),
    )
    r = F.hypot("s", "c")
    return circular.crossJoin(F.broadcast(shape)).select(
        "dominant", "secondary", F.when(r >= 1e-9, F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))).alias("mean"), r.alias("r"),
        F.coalesce("anisotropy", F.lit(0.0)).alias("anisotropy"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"), "n", "total_km",
    )
