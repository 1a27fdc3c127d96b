"""Hypsometric curves and integrals of basins, and their grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(cells: DataFrame, least_cells: int = 10) -> DataFrame:
    """basin_id, z_min, z_max, relief, n_cells of basins with ``least_cells`` known cells or more."""
    known = cells.where("z is not null").groupBy("basin_id").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count("*").alias("n_cells"))
    return known.where(F.col("n_cells") >= least_cells).withColumn("relief", F.col("z_max") - F.col("z_min"))


def skipped(cells: DataFrame, least_cells: int = 10) -> DataFrame:
    """basin_id and reason of the basins left out."""
    few = cells.groupBy("basin_id").agg(F.count("z").alias("n")).where(F.col("n") < least_cells)
    return few.select("basin_id", F.lit("insufficient valid pixels").alias("reason"))


def curve(cells: DataFrame, n_points: int = 200, least_cells: int = 10) -> DataFrame:
    """basin_id, p, area_fraction, elev_fraction: elevation above the lowest at equal shares of area, from the top.

    Every cell is ranked within its basin; a cell makes the points whose rank is its own, so the
    points are not joined with the cells. A flat basin is 0.5 throughout.
    """
    by_height = Window.partitionBy("basin_id").orderBy(F.desc("z"))
    basin = Window.partitionBy("basin_id")
    ranked = cells.where("z is not null").select(
        "basin_id", "z", (F.row_number().over(by_height) - 1).alias("rank"),
        F.count("*").over(basin).alias("n"), F.min("z").over(basin).alias("low"), F.max("z").over(basin).alias("high"),
    ).where(F.col("n") >= least_cells)
    last = n_points - 1
    # Point p stands at rank floor(p (n - 1) / (P - 1)): those of a rank run from ceil(rank (P - 1) / (n - 1)).
    span = F.col("n") - 1
    first = F.floor((F.col("rank") * last + span - 1) / span)
    end = F.floor(((F.col("rank") + 1) * last + span - 1) / span) - 1
    points = F.filter(F.sequence(first, F.greatest(end, first)), lambda p: (p <= end) & (p <= last))
    height = F.when(F.col("high") - F.col("low") > 1e-10, (F.col("z") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).otherwise(F.lit(0.5))
    return ranked.select("basin_id", F.explode(points).alias("p"), height.alias("elev_fraction")).select(
        "basin_id", "p", (F.col("p") / float(last)).alias("area_fraction"), "elev_fraction"
    )


def integral(points: DataFrame) -> DataFrame:
    """basin_id, hi: the area under the curve, to four digits."""
    w = Window.partitionBy("basin_id").orderBy("p")
    step = (F.col("elev_fraction") + F.lag("elev_fraction").over(w)) / 2 * (F.col("area_fraction") - F.lag("area_fraction").over(w))
    return points.select("basin_id", step.alias("s")).groupBy("basin_id").agg(F.round(F.sum("s"), 4).alias("hi"))


def stage(hi: Column) -> Column:
    """Young above 0.6, old below 0.4, else mature."""
    return F.when(hi >= 0.6, "young").when(hi < 0.4, "old").otherwise("mature")


def _shown(v: Column) -> Column:
    """Two digits under 10, none from there on."""
    return F.when(F.abs(v) < 10, F.format_string("%.2f", v)).otherwise(F.format_string("%.0f", v))


def grouped(results: DataFrame, field: str, prefix: str, n_bins: int = 4) -> DataFrame:
    """``results`` (basin_id, label, …) with group_no and group_label: equal-width bins of ``field``.

    The last bin is closed; empty bins have no rows; null and non-finite values are ``No data``;
    without spread all are one group. The field ``none`` makes each basin a group of its own.
    """
    if field == "none":
        return results.withColumn("group_no", F.col("basin_id")).withColumn("group_label", F.col("label"))
    v = F.when((F.abs(F.col(field)) < float("inf")) & ~F.isnan(field), F.col(field))
    ends = results.agg(F.min(v).alias("lo_"), F.max(v).alias("hi_"))
    both = results.crossJoin(F.broadcast(ends))  # one row
    edge = lambda i: F.col("lo_") + (F.col("hi_") - F.col("lo_")) * i / n_bins
    no = F.lit(n_bins - 1)
    label = F.concat(F.lit(f"{prefix} "), _shown(edge(n_bins - 1)), F.lit(" – "), _shown(F.col("hi_")))
    for i in reversed(range(n_bins - 1)):
        under = v < edge(i + 1)
        label = F.when(under, F.concat(F.lit(f"{prefix} "), _shown(edge(i)), F.lit(" – "), _shown(edge(i + 1)))).otherwise(label)
        no = F.when(under, F.lit(i)).otherwise(no)
    flat = F.col("hi_") - F.col("lo_") < 1e-9
    return both.select(
        *results.columns,
        F.when(v.isNull(), F.lit(n_bins)).when(flat, F.lit(0)).otherwise(no).alias("group_no"),
        F.when(v.isNull(), F.lit("No data")).when(flat, F.concat(F.lit(f"{prefix} "), _shown(F.col("lo_")))).otherwise(label).alias("group_label"),
    )


def chunked(groups: DataFrame, most: int = 6) -> DataFrame:
    """Groups of more than ``most`` members in chunks; chunk_label says which members a chunk holds."""
    w = Window.partitionBy("group_no").orderBy("basin_id")
    most = max(1, most)
    n = F.count("*").over(Window.partitionBy("group_no"))
    pos = F.row_number().over(w) - 1
    rows = groups.withColumn("n_", n).withColumn("chunk", F.when(F.col("n_") > most, F.floor(pos / most)).otherwise(F.lit(0)).cast("long"))
    start = F.col("chunk") * most + 1
    size = F.least(F.lit(most).cast("long"), F.col("n_") - F.col("chunk") * most)
    suffix = F.concat(F.lit("  ["), start.cast("string"), F.lit("–"), (start + size - 1).cast("string"), F.lit("]  ·  "), size.cast("string"), F.lit(" curves"))
    return rows.withColumn("chunk_label", F.when(F.col("n_") > most, F.concat("group_label", suffix)).otherwise(F.col("group_label"))).drop("n_")


def group_statistics(groups: DataFrame, *keys: str) -> DataFrame:
    """n, hi_min, hi_max, hi_mean (3 digits), area_total_km2, area_mean_km2 and relief_mean (1 digit) of each group.

    Rounded as decimals of nine digits: the last bits of a sum depend on its order, and would decide at halves.
    """
    finite = lambda c: F.when((F.abs(F.col(c)) < float("inf")) & ~F.isnan(c), F.col(c))
    rounded = lambda v, digits: F.coalesce(F.round(v.try_cast("decimal(24,9)"), digits).cast("double"), F.round(v, digits))
    return groups.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rounded(F.min(finite("hi")), 3).alias("hi_min"),
        rounded(F.max(finite("hi")), 3).alias("hi_max"),
        rounded(F.avg(finite("hi")), 3).alias("hi_mean"),
        rounded(F.sum(finite("area_km2")), 1).alias("area_total_km2"),
        rounded(F.avg(finite("area_km2")), 1).alias("area_mean_km2"),
        rounded(F.avg(finite("relief")), 1).alias("relief_mean"),
    )


def moved_to_ungrouped(groups: DataFrame, basin_id: int) -> DataFrame:
    """``groups`` with one basin in a last group of its own; emptied groups have no rows. Unknown basins change nothing."""
    mine = F.col("basin_id") == basin_id
    return groups.withColumn("group_no", F.when(mine, F.lit(1 << 30)).otherwise(F.col("group_no"))).withColumn(
        "group_label", F.when(mine, F.lit("Ungrouped")).otherwise(F.col("group_label"))
    )
