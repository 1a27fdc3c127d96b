"""The tables that each tool hands out: column names, roundings and order as users' sheets and maps expect them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: str | Column) -> Column:
    """Null for NaN and the infinities."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _rounded(**digits: int) -> list[Column]:
    return [F.round(finite(c), n).alias(c) for c, n in digits.items()]


def river_profile(profile: DataFrame) -> DataFrame:
    """dist_m, elev_m, area_m2, slope, sl, slk, chi and ksn of an analysed profile, with basin_id and idx to order them by."""
    named = profile.withColumnRenamed("elev", "elev_m")
    return named.select("basin_id", "idx", *_rounded(dist_m=1, elev_m=2, area_m2=1, slope=6, sl=2, slk=4, chi=4, ksn=2))


def knickpoints(found: DataFrame, names: DataFrame) -> DataFrame:
    """basin, chi, dist_m, elev_m; ``names`` holds basin_id and label."""
    return found.join(names, "basin_id").select(F.col("label").alias("basin"), "chi", "dist_m", "elev_m")


def river_summary(summary: DataFrame, found: DataFrame, lengths: DataFrame, names: DataFrame, theta: float) -> DataFrame:
    """label, fid, sl_max, slk_max, chi_max, ksn_mean, ksn_max, theta_local, theta_ref, n_knickpoints, length_km."""
    counted = found.groupBy("basin_id").agg(F.count("*").alias("n_knickpoints"))
    return (
        summary.join(names, "basin_id").join(lengths, "basin_id", "left").join(counted, "basin_id", "left").select(
            "label", F.col("basin_id").alias("fid"), "sl_max", "slk_max", "chi_max", "ksn_mean", "ksn_max", F.col("theta_mean").alias("theta_local"),
            F.lit(theta).alias("theta_ref"), F.coalesce("n_knickpoints", F.lit(0)).cast("long").alias("n_knickpoints"), length_km(F.col("length_m")).alias("length_km"),
        )
    )


def length_km(metres: Column) -> Column:
    return F.round(metres / 1000, 3)


def fleet(summary: DataFrame) -> DataFrame:
    """Means over basins of a river summary: slk_max, ksn_mean and the number of knickpoints."""
    return summary.agg(F.avg("slk_max").alias("slk_max"), F.avg("ksn_mean").alias("ksn_mean"), F.avg("n_knickpoints").alias("n_knickpoints"))


def hypsometry_summary(results: DataFrame) -> DataFrame:
    """label, fid, hi, area_km2, min_elev, max_elev, relief, n_pixels; a group's table is the same of its members."""
    return results.select("label", F.col("basin_id").alias("fid"), "hi", "area_km2", F.col("z_min").alias("min_elev"), F.col("z_max").alias("max_elev"), "relief", F.col("n_cells").alias("n_pixels"))


def hypsometric_curve(points: DataFrame) -> DataFrame:
    return points.select("basin_id", "p", *_rounded(area_fraction=6, elev_fraction=6))


def channel_summary(metrics: DataFrame, counts: DataFrame, names: DataFrame) -> DataFrame:
    """label, fid, maxC, dL, concavity, length_km, n_points; ``counts`` holds basin_id, length_m, n_points."""
    return metrics.join(counts, "basin_id").join(names, "basin_id").select(
        "label", F.col("basin_id").alias("fid"), F.col("max_c").alias("maxC"), F.col("dl").alias("dL"), "concavity", length_km(F.col("length_m")).alias("length_km"), "n_points"
    )


def channel_profile(points: DataFrame) -> DataFrame:
    return points.select("basin_id", "idx", F.round("x", 6).alias("dist_norm"), F.round("y", 6).alias("elev_norm"))


CHANNEL_MEASURES = ("maxC", "dL", "concavity", "length_km")


def measure_pair(table: DataFrame, x: str, y: str) -> DataFrame:
    """Two different measures of a channel summary against each other."""
    if x == y or not {x, y} <= set(CHANNEL_MEASURES):
        raise ValueError(f"choose two different ones of {', '.join(CHANNEL_MEASURES)}")
    return table.select("label", "fid", F.col(x).alias("x"), F.col(y).alias("y"))


def swath(stations: DataFrame, quartiles: bool = False, relief: bool = True, hyps: bool = True) -> DataFrame:
    """distance_m, mean, min, max and, as asked for, q1 and q3, relief, hyps."""
    return stations.select(F.col("dist").alias("distance_m"), "mean", "min", "max", *(["q1", "q3"] if quartiles else []), *(["relief"] if relief else []), *(["hyps"] if hyps else []))


def swath_page(stations: DataFrame) -> DataFrame:
    """One row for each line: length_km (2 digits), max, min, mean and relief (1 digit) over its stations."""
    top, low = F.max("max"), F.min("min")
    return stations.groupBy("fid").agg(
        F.round(F.max("dist") / 1000, 2).alias("length_km"), F.round(top, 1).alias("max"), F.round(low, 1).alias("min"), F.round(F.avg("mean"), 1).alias("mean"), F.round(top - low, 1).alias("relief")
    )


def rose(bins: DataFrame) -> DataFrame:
    return bins.select(F.col("center").alias("azimuth"), "value")


def watershed(subbasins: DataFrame) -> DataFrame:
    return subbasins.select("rank", "area_km2", "area_m2", "n_pixels", "outlet_x", "outlet_y")


def watershed_totals(subbasins: DataFrame) -> DataFrame:
    """One row: n and total_km2 (2 digits)."""
    return subbasins.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("area_km2"), F.lit(0.0)), 2).alias("total_km2"))


def _line_wkt(vertices: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``wkt`` of lines in long form; every key's line is one row's value in the result."""
    points = F.transform(F.sort_array(F.collect_list(F.struct("vidx", "x", "y"))), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return vertices.groupBy(*keys).agg(F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")")).alias("wkt"))


def point_wkt(x: str = "x", y: str = "y") -> Column:
    return F.concat(F.lit("POINT ("), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"), F.lit(")"))


def polygon_wkt(rings: DataFrame, key: str = "fid") -> DataFrame:
    """``key`` and ``wkt`` (a MULTIPOLYGON) of rings in long form (part, ring, vidx, x, y); the first ring of a part is its outside."""
    points = F.transform(F.sort_array(F.collect_list(F.struct("vidx", "x", "y"))), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    ring = rings.groupBy(key, "part", "ring").agg(F.concat(F.lit("("), F.array_join(points, ", "), F.lit(")")).alias("t"))
    text = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, "t"))), lambda p: p["t"]), ", ")
    part = ring.groupBy(key, "part").agg(F.concat(F.lit("("), text("ring"), F.lit(")")).alias("t"))
    return part.groupBy(key).agg(F.concat(F.lit("MULTIPOLYGON ("), text("part"), F.lit(")")).alias("wkt"))


def river_layers(rivers: DataFrame, profile: DataFrame, table: DataFrame, segments: DataFrame, knicks: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """The four layers of the fluvial tool, geometry as WKT: main_rivers, ksn_segments, knickpoints, profile_points.

    ``rivers`` holds fid, vidx, x, y from source to mouth; ``profile`` an analysed profile; ``table``
    the river summary; ``segments`` and ``knicks`` what the profile was cut into.
    """
    from . import polylines, sampling

    named = names.withColumnRenamed("label", "basin")
    on_line = lambda df: sampling.place_at(rivers, df.select(F.col("basin_id").alias("fid"), F.col("dist_m").alias("dist")).distinct()).withColumnsRenamed({"fid": "basin_id", "dist": "dist_m"})
    main = table.join(_line_wkt(rivers, "fid"), "fid").select(F.col("label").alias("basin"), "length_km", "ksn_mean", "chi_max", "n_knickpoints", "wkt")
    at = lambda i, *c: profile.select("basin_id", F.col("idx").alias(i), *[F.col(x).alias(f"{x}_{i}") for x in c])
    spans = segments.join(at("i0", "dist_m", "elev"), ["basin_id", "i0"]).join(at("i1", "dist_m", "elev"), ["basin_id", "i1"])
    lines = rivers.join(spans.select(F.col("basin_id").alias("fid"), "i0", "dist_m_i0", "dist_m_i1"), "fid")
    keyed = lines.withColumn("fid", F.struct("fid", "i0", "dist_m_i0", "dist_m_i1"))
    low, high = F.least("fid.dist_m_i0", "fid.dist_m_i1"), F.greatest("fid.dist_m_i0", "fid.dist_m_i1")
    stretch = _line_wkt(polylines.between(keyed, low, high), "fid").select(F.col("fid.fid").alias("basin_id"), "fid.i0", "wkt")
    reaches = spans.join(stretch, ["basin_id", "i0"], "left").join(named, "basin_id").select(
        "basin", "ksn", "theta_local", F.abs(F.col("elev_i0") - F.col("elev_i1")).alias("elevation_drop_m"), F.col("elev_i0").alias("elevation_start_m"),
        F.abs(F.col("dist_m_i1") - F.col("dist_m_i0")).alias("length_m"), "wkt",
    )
    spots = knicks.join(on_line(knicks), ["basin_id", "dist_m"], "left").join(named, "basin_id")
    points = profile.join(on_line(profile), ["basin_id", "dist_m"], "left").join(named, "basin_id")
    return {
        "main_rivers": main,
        "ksn_segments": reaches,
        "knickpoints": spots.select("basin", F.col("elev_m").alias("elevation_m"), F.col("dist_m").alias("distance_m"), "chi", point_wkt().alias("wkt")),
        "profile_points": points.select(
            "basin", F.col("dist_m").alias("distance_m"), F.col("elev").alias("elevation_m"), "chi", "ksn", F.col("sl").alias("sl_index"), F.col("slk").alias("slk_index"), point_wkt().alias("wkt")
        ),
    }


def with_distance(knicks: DataFrame, profile: DataFrame) -> DataFrame:
    """Knickpoints (basin_id, idx, chi, elev) with dist_m and elev_m of their profile point; without such a point the distance is 0."""
    at = profile.select("basin_id", "idx", F.round("dist_m", 1).alias("dist_m"))
    return knicks.select("basin_id", "idx", "chi", F.col("elev").alias("elev_m")).join(at, ["basin_id", "idx"], "left").fillna(0.0, ["dist_m"])


def unit_colours(units: DataFrame, colours: DataFrame) -> DataFrame:
    """Map units (cluster) with the colour of their cluster (cluster, r, g, b), as cluster_id and hex_color."""
    from . import mapunits

    named = colours.select("cluster", mapunits.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("hex_color"))
    return units.join(named, "cluster").withColumnRenamed("cluster", "cluster_id")


def ranked_colours(subbasins: DataFrame) -> DataFrame:
    """Sub-basins with the colour of their rank."""
    from . import flow

    return subbasins.withColumn("hex_color", flow.rank_colour(F.col("rank")))

