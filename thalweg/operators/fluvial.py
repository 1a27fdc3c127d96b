"""River steepness: stream-length index, chi, k_sn, concavity, knickpoints, segments, equilibrium.

Profiles run from the source (idx 0) to the mouth; chi is aligned with them, 0 at the mouth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import along

#: Points that a segment needs, on each side of a knickpoint too.
SEGMENT_POINTS = 8


def _basin() -> Window:
    return along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def stream_length(profile: DataFrame) -> DataFrame:
    """sl and slk: the gradient to the next point times the distance from the source, and that over the ideal gradient."""
    w = along()
    dz, dd = F.col("elev") - F.lead("elev").over(w), F.lead("dist_m").over(w) - F.col("dist_m")
    back_z, back_d = F.lag("elev").over(w) - F.col("elev"), F.col("dist_m") - F.lag("dist_m").over(w)
    inner = F.when(dd < 1e-6, F.lit(0.0)).otherwise(F.greatest(F.try_divide(dz, dd) * F.col("dist_m"), F.lit(0.0)))
    last = F.when(back_d >= 1e-6, F.try_divide(back_z, back_d) * F.col("dist_m")).otherwise(F.lit(0.0))
    out = profile.withColumn("sl", F.when(F.lead("idx").over(w).isNull(), last).otherwise(inner))
    height = F.abs(F.first("elev").over(_basin()) - F.last("elev").over(_basin()))
    length = F.last("dist_m").over(_basin())
    out = out.withColumn("h_", height).withColumn("l_", length)
    ideal = F.greatest(F.col("h_") / F.log(F.when(F.col("l_") > 1, F.col("l_"))), F.lit(1e-10))
    usable = (F.col("l_") > 1) & (F.col("h_") > 0)
    return out.withColumn("slk", F.when(usable, F.col("sl") / F.when(usable, ideal)).otherwise(F.col("sl"))).drop("h_", "l_")


def chi(profile: DataFrame, theta: float = 0.45, a0: float = 1.0) -> DataFrame:
    """``chi``: the integral of (a0 / area) ** theta from the mouth upstream."""
    w = along()
    weight = F.pow(F.lit(a0) / F.col("area_m2"), F.lit(theta))
    weighed = profile.withColumn("w_", weight)
    step = (F.col("w_") + F.lead("w_").over(w)) / 2 * (F.lead("dist_m").over(w) - F.col("dist_m"))
    up = Window.partitionBy("basin_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    return weighed.withColumn("s_", F.coalesce(step, F.lit(0.0))).withColumn("chi", F.sum("s_").over(up)).drop("w_", "s_")


def steepness(profile: DataFrame, theta: float = 0.45, most: float = 1500.0) -> DataFrame:
    """``ksn`` = slope x area ** theta; null outside (0, most)."""
    k = F.col("slope") * F.pow("area_m2", F.lit(theta))
    return profile.withColumn("ksn", F.when((k > 0) & (k < most), k))


def concavity(profile: DataFrame, theta: float = 0.45) -> DataFrame:
    """``theta_local``: |slope| of log slope on log area in a window of about 125 m around each point.

    The window's size follows a basin's spacing of points, so its sums are differences of running
    sums, met by position. Points too near an end for a whole window keep ``theta``; so does a
    profile no longer than its window. Areas that hardly vary give 0.
    """
    w = along()
    basin = Window.partitionBy("basin_id")
    lx, ly = F.log10(F.greatest("area_m2", F.lit(1e-6))), F.log10(F.greatest("slope", F.lit(1e-10)))
    logs = profile.withColumn("x_", lx).withColumn("y_", ly).withColumn("n_", F.count("*").over(basin))
    # Centred on the basin's means: the differences of sums then lose no digits.
    logs = logs.withColumn("x_", F.col("x_") - F.avg("x_").over(basin)).withColumn("y_", F.col("y_") - F.avg("y_").over(basin))
    spacing = (F.last("dist_m").over(_basin()) - F.first("dist_m").over(_basin())) / F.col("n_")
    p = F.floor(F.lit(125.0) / F.nullif(spacing, F.lit(0.0)))
    logs = logs.withColumn("p_", F.coalesce(p, F.lit(0))).withColumn("win_", F.greatest(F.lit(8), F.when(F.col("p_") % 2 == 0, F.col("p_") + 1).otherwise(F.col("p_"))))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = logs
    for name, v in {"sx": F.col("x_"), "sy": F.col("y_"), "sxx": F.col("x_") * F.col("x_"), "sxy": F.col("x_") * F.col("y_")}.items():
        sums = sums.withColumn(name, F.sum(v).over(run))
    half = F.floor(F.col("win_") / 2)
    keyed = sums.withColumn("lo_", F.col("idx") - half - 1).withColumn("hi_", F.col("idx") - half + F.col("win_") - 1)
    at = lambda tag: sums.select("basin_id", F.col("idx").alias(f"{tag}_"), *[F.col(c).alias(f"{c}_{tag}") for c in ("sx", "sy", "sxx", "sxy")])
    met = keyed.join(at("lo"), ["basin_id", "lo_"], "left").join(at("hi"), ["basin_id", "hi_"], "left")
    d = {c: F.col(f"{c}_hi") - F.coalesce(F.col(f"{c}_lo"), F.lit(0.0)) for c in ("sx", "sy", "sxx", "sxy")}
    size = F.col("win_")
    sxx, sxy = d["sxx"] - d["sx"] * d["sx"] / size, d["sxy"] - d["sx"] * d["sy"] / size
    whole = (F.col("n_") > size) & (F.col("idx") >= half) & (F.col("hi_") <= F.col("n_") - 1)
    slope = F.when(sxx > 1e-6, F.abs(sxy / F.when(sxx > 1e-6, sxx))).otherwise(F.lit(0.0))
    return met.select(*profile.columns, F.when(whole, slope).otherwise(F.lit(theta)).alias("theta_local"))


def equilibrium(profile: DataFrame) -> DataFrame:
    """``equilibrium``: the logarithmic profile from the highest to the lowest point; a mean level without extent."""
    basin = Window.partitionBy("basin_id")
    least = F.min(F.when(F.col("dist_m") > 0, F.col("dist_m"))).over(basin)
    safe = F.when(F.col("dist_m") > 0, F.col("dist_m")).otherwise(F.coalesce(least, F.lit(1.0)))
    out = profile.withColumn("d_", safe).withColumn("hi_", F.max("elev").over(basin)).withColumn("lo_", F.min("elev").over(basin))
    start = F.log10(F.min("d_").over(basin))
    span = F.log10(F.last("d_").over(_basin())) - start
    curve = F.col("hi_") - (F.col("hi_") - F.col("lo_")) / F.when(F.abs(F.col("span_")) >= 1e-10, F.col("span_")) * (F.log10("d_") - F.col("start_"))
    out = out.withColumn("start_", start).withColumn("span_", span)
    return out.withColumn("equilibrium", F.coalesce(curve, (F.col("hi_") + F.col("lo_")) / 2)).drop("d_", "hi_", "lo_", "start_", "span_")


def chi_line(profile: DataFrame) -> DataFrame:
    """basin_id, z_mouth and z_source of the line in chi space with the basin's mean k_sn."""
    z0 = F.min_by("elev", F.struct("chi", -F.col("idx")))
    return profile.groupBy("basin_id").agg(z0.alias("z_mouth"), (z0 + F.avg("ksn") * (F.max("chi") - F.min("chi"))).alias("z_source"))


_SUMS = ("sx", "sy", "sxx", "sxy", "syy")


def _rss(low: str, high: str, first: str, last: str) -> Column:
    """Sum of squares about the line of the points between two sets of running sums, infinite where x does not change from ``first`` to ``last``."""
    d = {c: F.col(f"{high}{c}") - F.col(f"{low}{c}") for c in ("n", *_SUMS)}
    sxx = d["sxx"] - d["sx"] * d["sx"] / d["n"]
    sxy = d["sxy"] - d["sx"] * d["sy"] / d["n"]
    syy = d["syy"] - d["sy"] * d["sy"] / d["n"]
    steep = F.abs(F.col(first) - F.col(last)) < 1e-10
    return F.when(steep, F.lit(float("inf"))).otherwise(syy - sxy * sxy / F.when(~steep, sxx))


def knickpoints(profile: DataFrame, depth: int = 3, points: int = SEGMENT_POINTS) -> DataFrame:
    """basin_id, idx, chi, elev: breaks of the chi profile, by repeated splitting in two.

    A stretch is split where two straight lines leave the least sum of squares, with ``points`` on
    each side; both parts are split again, ``depth`` levels deep, and the first ``depth`` breaks in
    order of position stay. Every point is a row with its basin's running sums and its stretch's
    ends; a level takes the best candidate of each stretch by an aggregate.
    """
    from ..functions.lineage import cut

    basin = Window.partitionBy("basin_id")
    valid = profile.where("chi is not null and elev is not null").withColumn("x", F.col("chi") - F.avg("chi").over(basin)).withColumn("y", F.col("elev") - F.avg("elev").over(basin))
    run = along().rowsBetween(Window.unboundedPreceding, 0)
    terms = {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y")}
    rows = valid.select("basin_id", "idx", "chi", "elev", "x", (F.row_number().over(along())).cast("long").alias("n"), *[F.sum(v).over(run).alias(c) for c, v in terms.items()])
    # ``b``: sums over all points before this one; a point's place is their number.
    before = [F.coalesce(F.lag(c).over(along()), F.lit(0).cast("long") if c == "n" else F.lit(0.0)).alias(f"b{c}") for c in ("n", *_SUMS)]
    every = cut(rows.select("basin_id", "idx", "chi", "elev", "x", F.lag("x").over(along()).alias("x_before"), "n", *_SUMS, *before), "points")
    state = every.withColumn("i", F.lit(0).cast("long")).withColumn("j", F.count("*").over(basin))
    found = None
    for _ in range(depth):
        state = cut(state, "stretches")
        # A stretch's ends: sums before its first point and up to its last one.
        first = state.where("bn = i").select("basin_id", "i", F.col("x").alias("x_i"), *[F.col(f"b{c}").alias(f"i{c}") for c in ("n", *_SUMS)])
        last = state.where("n = j").select("basin_id", "i", F.col("x").alias("x_j"), *[F.col(c).alias(f"j{c}") for c in ("n", *_SUMS)])
        inner = state.where((F.col("j") - F.col("i") > 2 * points) & (F.col("bn") >= F.col("i") + points) & (F.col("bn") < F.col("j") - points))
        met = inner.join(first, ["basin_id", "i"]).join(last, ["basin_id", "i"])
        total = _rss("i", "b", "x_i", "x_before") + _rss("b", "j", "x", "x_j")
        tried = met.select("basin_id", "i", total.alias("rss"), "bn").where(F.col("rss") < float("inf"))
        best = cut(tried.groupBy("basin_id", "i").agg(F.min_by("bn", F.struct("rss", "bn")).alias("at")), "breaks")
        found = best.select("basin_id", "at") if found is None else found.unionByName(best.select("basin_id", "at"))
        split = state.join(best, ["basin_id", "i"])  # a stretch without a break is done
        right = F.col("bn") >= F.col("at")
        state = split.withColumn("j", F.when(right, F.col("j")).otherwise(F.col("at"))).withColumn("i", F.when(right, F.col("at")).otherwise(F.col("i"))).drop("at")
    if found is None:
        return every.select("basin_id", "idx", "chi", "elev").limit(0)
    order = Window.partitionBy("basin_id").orderBy("at")
    kept = found.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= depth)
    return every.join(kept.select("basin_id", F.col("at").alias("bn")), ["basin_id", "bn"]).select("basin_id", "idx", "chi", "elev")


def stretches(profile: DataFrame, breaks: DataFrame) -> DataFrame:
    """basin_id, i0, i1: the stretches between source, breaks and mouth."""
    ends = profile.groupBy("basin_id").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).select("basin_id", F.explode(F.array("a", "b")).alias("idx"))
    every = ends.unionByName(breaks.select("basin_id", "idx")).distinct()
    w = Window.partitionBy("basin_id").orderBy("idx")
    return every.select("basin_id", F.col("idx").alias("i0"), F.lead("idx").over(w).alias("i1")).where("i1 is not null")


def segments(profile: DataFrame, breaks: DataFrame, method: str = "chi_slope", theta: float = 0.45, points: int = SEGMENT_POINTS) -> DataFrame:
    """basin_id, i0, i1, chi_start, chi_end, elev_start, elev_end, ksn, theta_local of stretches of ``points`` or more.

    ``chi_slope``: drop over chi; ``regression``: from log slope on log area, carried to ``theta``
    at the middle of the area's range. Slopes of 1e-6 or less take no part in a regression.
    """
    if method not in ("chi_slope", "regression"):
        raise ValueError(f"unknown method {method}")
    spans = stretches(profile, breaks).where(F.col("i1") - F.col("i0") >= points)
    used = F.col("slope") > 1e-6
    x, y = F.when(used, F.log10("area_m2")), F.when(used, F.log10(F.when(used, F.col("slope"))))
    met = profile.join(spans, "basin_id").where("idx between i0 and i1")
    inside = F.col("idx") < F.col("i1")
    pick = lambda c, at: F.max(F.when(F.col("idx") == F.col(at), F.col(c)))
    xs, ys = F.when(inside, x), F.when(inside, y)
    got = met.groupBy("basin_id", "i0", "i1").agg(
        pick("chi", "i0").alias("chi_start"), pick("chi", "i1").alias("chi_end"), pick("elev", "i0").alias("elev_start"), pick("elev", "i1").alias("elev_end"),
        F.count(xs).alias("n"), F.regr_slope(ys, xs).alias("s"), F.regr_intercept(ys, xs).alias("c"), F.min(xs).alias("lo"), F.max(xs).alias("hi"),
    )
    if method == "chi_slope":
        dchi = F.abs(F.col("chi_start") - F.col("chi_end"))
        ksn = F.when(dchi > 1e-6, F.abs(F.col("elev_start") - F.col("elev_end")) / F.when(dchi > 1e-6, dchi)).otherwise(F.lit(0.0))
        local = F.when(F.col("n") > points, F.abs("s")).otherwise(F.lit(theta))
    else:
        got = got.where((F.col("n") >= points) & (F.col("hi") - F.col("lo") >= 0.01))
        local = F.abs("s")
        ksn = F.pow(F.lit(10.0), "c") * F.pow(F.pow(F.lit(10.0), (F.col("hi") + F.col("lo")) / 2), theta - local)
    return got.select(
        "basin_id", "i0", "i1", F.round("chi_start", 4).alias("chi_start"), F.round("chi_end", 4).alias("chi_end"), F.round("elev_start", 2).alias("elev_start"),
        F.round("elev_end", 2).alias("elev_end"), F.round(ksn, 2).alias("ksn"), F.round(local, 4).alias("theta_local"),
    )


def reaches(profile: DataFrame, parts: DataFrame) -> DataFrame:
    """Segments with ``drop_m`` and ``reach_m``."""
    at = lambda c: profile.select("basin_id", F.col("idx").alias(c), F.col("dist_m").alias(f"d_{c}"))
    met = parts.join(at("i0"), ["basin_id", "i0"]).join(at("i1"), ["basin_id", "i1"])
    return met.select(*parts.columns, F.abs(F.col("elev_start") - F.col("elev_end")).alias("drop_m"), F.abs(F.col("d_i1") - F.col("d_i0")).alias("reach_m"))


def summary(profile: DataFrame) -> DataFrame:
    """basin_id, sl_max, slk_max, chi_max, ksn_mean, ksn_max, theta_mean: over the values there are, 0 without any."""
    of = lambda c, name, digits: F.coalesce(F.round(c, digits), F.lit(0.0)).alias(name)
    return profile.groupBy("basin_id").agg(
        of(F.max("sl"), "sl_max", 2), of(F.max("slk"), "slk_max", 4), of(F.max("chi"), "chi_max", 4), of(F.avg("ksn"), "ksn_mean", 2), of(F.max("ksn"), "ksn_max", 2), of(F.avg("theta_local"), "theta_mean", 4)
    )


def analysed(profile: DataFrame, theta: float = 0.45, a0: float = 1.0, smooth: int = 0) -> DataFrame:
    """A profile (basin_id, idx, dist_m, elev, area_m2) with every point-wise metric; runs from high to low."""
    from . import series

    turned = series.high_to_low(profile).drop("turn")
    out = stream_length(turned)
    if smooth >= 3:
        out = series.smoothed(out, "elev", smooth, out="z_").withColumn("elev", F.col("z_")).drop("z_")
    return equilibrium(concavity(steepness(chi(series.slope(out), theta, a0), theta), theta))


def again(profile: DataFrame, theta: float, a0: float = 1.0) -> DataFrame:
    """An analysed profile for another ``theta``, without sampling anew."""
    return concavity(steepness(chi(profile.drop("chi", "ksn", "theta_local"), theta, a0), theta), theta)


def geographic_cell_m(px_w: float, centre_lat: Column) -> Column:
    """A geographic pixel's width in metres at a latitude."""
    return F.abs(F.lit(px_w)) * F.lit(3.141592653589793 / 180 * 6371000.0) * F.cos(F.radians(centre_lat))
