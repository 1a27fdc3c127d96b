"""Polylines in long form (fid, vidx, x, y): segments, distances along a line, stations and transversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("vidx")


def segments(vertices: DataFrame, min_length: float = 0.0) -> DataFrame:
    """fid, vidx (of the first end), dx, dy, len, az: azimuth clockwise from north in [0, 360)."""
    w = along("fid")
    step = vertices.select("fid", "vidx", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    d = step.select("fid", "vidx", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))
    sized = d.withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return sized.where(F.col("len") >= min_length).withColumn("az", F.pmod(F.degrees(F.atan2("dx", "dy")), F.lit(360.0)))


def rectitude(vertices: DataFrame) -> DataFrame:
    """fid, straight, total, rectitude: straight over true length; 0 for a line without length."""
    w = along("fid")
    step = vertices.withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    ends = step.groupBy("fid").agg(
        F.sum(F.coalesce("d", F.lit(0.0))).alias("total"),
        F.min_by(F.struct("x", "y"), "vidx").alias("a"),
        F.max_by(F.struct("x", "y"), "vidx").alias("b"),
    )
    straight = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return ends.select("fid", straight.alias("straight"), "total", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(straight / F.nullif("total", F.lit(0.0))).alias("rectitude"))


def keep_straight(vertices: DataFrame, min_rectitude: float) -> DataFrame:
    """The lines of that rectitude or more; all of them for 0."""
    if min_rectitude <= 0:
        return vertices
    return vertices.join(rectitude(vertices).where(F.col("rectitude") >= min_rectitude).select("fid"), "fid", "left_semi")


def densified(segs: DataFrame, step: float) -> DataFrame:
    """Segments longer than ``step`` become int(len / step) equal ones."""
    if step <= 0:
        return segs
    parts = F.when(F.col("len") > step, F.floor(F.col("len") / step)).otherwise(F.lit(1).cast("long"))
    return segs.withColumn("parts", parts).withColumn("len", F.col("len") / F.col("parts")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts")))).drop("parts", "copy")


def measured(vertices: DataFrame) -> DataFrame:
    """Vertices with ``cum``, the distance from the line's start; steps that are null count as 0."""
    w = along("fid")
    d = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return vertices.withColumn("d", F.coalesce(F.greatest(F.nanvl(d, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).withColumn(
        "cum", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def stations(vertices: DataFrame, n: int) -> DataFrame:
    """fid, station, dist, x, y: ``n`` places equally spaced along each line.

    A station takes the first segment whose end is at or beyond it. Each segment makes the stations
    that lie in it, so nothing is joined.
    """
    w = along("fid")
    spans = measured(vertices).select(
        "fid", "vidx", "x", "y", "cum",
        F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.lag("cum").over(w).alias("pcum"),
        F.max("cum").over(Window.partitionBy("fid")).alias("total"),
    ).where("pcum is not null and total >= 1e-10 and (cum > pcum or vidx = 1)")
    places = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda k: F.col("total") * k / F.lit(float(n - 1))
    # Rounding in total * k / (n - 1) may pass the end by an ulp: the last station is the end itself.
    spot = lambda k: F.when(k == n - 1, F.col("total")).otherwise(at(k))
    mine = F.filter(places, lambda k: (spot(k) <= F.col("cum")) & ((spot(k) > F.col("pcum")) | (F.col("vidx") == 1)))
    got = spans.withColumn("station", F.explode(mine)).withColumn("dist", spot(F.col("station")))
    size = F.col("cum") - F.col("pcum")
    t = (F.col("dist") - F.col("pcum")) / F.nullif(size, F.lit(0.0))
    on = lambda a, b: F.when(size < 1e-10, F.col(b)).otherwise(F.col(a) + t * (F.col(b) - F.col(a)))
    return got.select("fid", F.col("station").cast("long").alias("station"), "dist", on("px", "x").alias("x"), on("py", "y").alias("y"))


def transversals(spots: DataFrame, half_width: float, n: int, geographic: bool = False) -> DataFrame:
    """fid, station, j, tx, ty: ``n`` places across the line at each station, from one side to the other."""
    w = Window.partitionBy("fid").orderBy("station")
    ahead, behind = (lambda c: F.coalesce(F.lead(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lag(c).over(w), F.col(c)))
    tangent = spots.withColumn("dx", ahead("x") - behind("x")).withColumn("dy", ahead("y") - behind("y")).withColumn("h", F.hypot("dx", "dy"))
    wide_x = F.lit(half_width) / (F.lit(111320.0) * F.cos(F.radians("y"))) if geographic else F.lit(half_width)
    wide_y = F.lit(half_width / 111320.0) if geographic else F.lit(half_width)
    t = F.lit(-1.0) + F.lit(2.0) * F.col("j") / F.lit(float(n - 1)) if n > 1 else F.lit(-1.0)
    h = F.nullif("h", F.lit(0.0))
    place = lambda c, slope, wide: F.when(F.col("h") < 1e-10, F.col(c)).otherwise(F.col(c) + t * wide * slope / h)
    return tangent.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select(
        "fid", "station", "j", place("x", -F.col("dy"), wide_x).alias("tx"), place("y", F.col("dx"), wide_y).alias("ty")
    )


def _walks(vertices: DataFrame, pixel: float, share: float) -> DataFrame:
    """fid, vidx, x, y, x2, y2, steps of each segment with a length."""
    w = along("fid")
    length = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    segs = vertices.select("fid", "vidx", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null").where(length >= 1e-6)
    return segs.withColumn("steps", F.greatest(F.ceil(length / F.lit(share * pixel)), F.lit(1).cast("long")))


def step_count(vertices: DataFrame, pixel: float, share: float = 0.3) -> int:
    """How many steps ``walked`` makes of all lines."""
    return _walks(vertices, pixel, share).agg(F.sum("steps")).first()[0] or 0


def walked(vertices: DataFrame, pixel: float, share: float = 0.3) -> DataFrame:
    """fid, idx, x, y: steps of ``share`` pixels along each segment; the last vertex is left out, and segments without length are."""
    # Steps are numbered from those of the segments before theirs, so that only segments are sorted.
    before = F.coalesce(F.sum("steps").over(along("fid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    each = _walks(vertices, pixel, share).withColumn("before", before).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1)))
    t = F.col("s") / F.col("steps")
    on = lambda a, b: F.col(a) + t * (F.col(b) - F.col(a))
    return each.select("fid", (F.col("before") + F.col("s")).alias("idx"), on("x", "x2").alias("x"), on("y", "y2").alias("y"))


def between(vertices: DataFrame, low: Column, high: Column) -> DataFrame:
    """fid, vidx, x, y of the stretch between two distances from a line's start, with interpolated ends."""
    w = along("fid")
    spans = measured(vertices).select("fid", "vidx", "x", "y", "cum", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.lag("cum").over(w).alias("pcum"))
    cut = spans.where(F.col("pcum").isNotNull() & (F.col("cum") > F.col("pcum")) & (F.col("cum") > low) & (F.col("pcum") < high))
    on = lambda a, b, d: F.col(a) + (d - F.col("pcum")) / (F.col("cum") - F.col("pcum")) * (F.col(b) - F.col(a))
    first, last = F.greatest(F.col("pcum"), low), F.least(F.col("cum"), high)
    point = lambda d: F.struct(d.alias("d"), on("px", "x", d).alias("x"), on("py", "y", d).alias("y"))
    points = cut.select("fid", F.explode(F.array(point(first), point(last))).alias("p")).select("fid", "p.d", "p.x", "p.y").distinct()
    return points.select("fid", (F.row_number().over(Window.partitionBy("fid").orderBy("d")) - 1).cast("long").alias("vidx"), "d", "x", "y")
