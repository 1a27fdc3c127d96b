"""Polygons whose rings cross or overlap, made sound: the region that the even-odd rule gives them, as new rings.

Edges of one polygon meet in the squares that both touch, and are split where they meet. Pieces
that lie on each other cancel in pairs. Each piece left has the region on one side: it is turned to
have it on its left, and followed by the next piece around its end that bounds the same wedge.
Only polygons at fault go through this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import graphs, grid

#: Digits to which places where edges meet are rounded, so that all edges there have one end.
DIGITS = 7


def _edges(rings: DataFrame) -> DataFrame:
    """fid, k, ax, ay, bx, by: edges of more than a point, numbered."""
    w = Window.partitionBy("fid", "part", "ring").orderBy("vidx")
    place = lambda c: F.round(c, DIGITS)
    ends = rings.select("fid", place("x").alias("ax"), place("y").alias("ay"), F.lead(place("x")).over(w).alias("bx"), F.lead(place("y")).over(w).alias("by"))
    return ends.where("bx is not null and (ax <> bx or ay <> by)").withColumn("k", F.monotonically_increasing_id())


def _squares(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(F.least(lo, hi) / cell), F.floor(F.greatest(lo, hi) / cell)))


def meetings(edges: DataFrame, cell: float) -> DataFrame:
    """fid, k, x, y: where an edge is met by another of its polygon, other than at an end of both."""
    dealt = edges.withColumn("tx", _squares(F.col("ax"), F.col("bx"), cell)).withColumn("ty", _squares(F.col("ay"), F.col("by"), cell))
    other = dealt.select("fid", "tx", "ty", F.col("k").alias("l"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    # Edges are sized before they are expanded to squares: without the hint they might be broadcast.
    pairs = dealt.hint("merge").join(other, ["fid", "tx", "ty"]).where("k < l").drop("tx", "ty").distinct()
    cross = lambda ux, uy, vx, vy: ux * vy - uy * vx
    c = F.col
    ux, uy, vx, vy = c("bx") - c("ax"), c("by") - c("ay"), c("dx") - c("cx"), c("dy") - c("cy")
    turn = cross(ux, uy, vx, vy)
    t = F.try_divide(cross(c("cx") - c("ax"), c("cy") - c("ay"), vx, vy), turn)
    s = F.try_divide(cross(c("cx") - c("ax"), c("cy") - c("ay"), ux, uy), turn)
    spot = lambda x, y: F.struct(F.round(x, DIGITS).alias("x"), F.round(y, DIGITS).alias("y"))
    across = F.when((t >= 0) & (t <= 1) & (s >= 0) & (s <= 1), spot(c("ax") + t * ux, c("ay") + t * uy))

    def on(px: Column, py: Column, x0: Column, y0: Column, wx: Column, wy: Column) -> Column:
        """The point if it lies on the edge from (x0, y0) along (wx, wy)."""
        length = wx * wx + wy * wy
        along = (px - x0) * wx + (py - y0) * wy
        near = F.abs(cross(px - x0, py - y0, wx, wy)) <= 10.0**-DIGITS * F.sqrt(length)
        return F.when(near & (along >= 0) & (along <= length), spot(px, py))

    a, b, d, e = (c("ax"), c("ay")), (c("bx"), c("by")), (c("cx"), c("cy")), (c("dx"), c("dy"))
    ends = [on(*d, *a, ux, uy), on(*e, *a, ux, uy), on(*a, *d, vx, vy), on(*b, *d, vx, vy)]
    # An end on the other edge is the place itself; only where there is none is a crossing computed.
    none = F.coalesce(*ends).isNull()
    spots = F.array_compact(F.array(*ends, F.when(none, across)))
    met = pairs.withColumn("p", F.explode(spots))
    each = met.select("fid", F.explode(F.array(F.struct(c("k").alias("k"), *[c(n) for n in ("ax", "ay", "bx", "by")]), F.struct(c("l").alias("k"), c("cx").alias("ax"), c("cy").alias("ay"), c("dx").alias("bx"), c("dy").alias("by")))).alias("e"), "p")
    inner = F.expr("not (e.ax = p.x and e.ay = p.y) and not (e.bx = p.x and e.by = p.y)")
    return each.where(inner).select("fid", "e.k", "p.x", "p.y").distinct()


def _pieces(edges: DataFrame, met: DataFrame) -> DataFrame:
    """fid, p, q: edges split where they are met, without those that lie on another in pairs; p is the lesser end."""
    cuts = met.groupBy("fid", "k").agg(F.collect_list(F.struct("x", "y")).alias("spots"))
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    split = edges.join(cuts, ["fid", "k"], "left")
    far = lambda p: F.struct(((p["x"] - F.col("ax")) * (p["x"] - F.col("ax")) + (p["y"] - F.col("ay")) * (p["y"] - F.col("ay"))).alias("d"), p["x"].alias("x"), p["y"].alias("y"))
    every = F.concat(F.array(end("ax", "ay"), end("bx", "by")), F.coalesce("spots", F.array().cast("array<struct<x:double,y:double>>")))
    stops = split.withColumn("stops", F.array_sort(F.array_distinct(F.transform(every, far))))
    spans = F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda i: F.struct(F.get("stops", i).alias("p"), F.get("stops", i + 1).alias("q")))
    place = lambda s: F.struct(F.col(f"s.{s}.x").alias("x"), F.col(f"s.{s}.y").alias("y"))
    each = stops.select("fid", F.explode(spans).alias("s")).select("fid", F.least(place("p"), place("q")).alias("p"), F.greatest(place("p"), place("q")).alias("q"))
    return each.where("p <> q").groupBy("fid", "p", "q").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def _turned(pieces: DataFrame, cell: float) -> DataFrame:
    """id, fid, ax, ay, bx, by: pieces with their region on the left, by the parity of what lies beside their middle."""
    flat = F.col("p.y") == F.col("q.y")
    named = cut(pieces.select("fid", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"), flat.alias("flat")).withColumn("id", F.monotonically_increasing_id()), "pieces")
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    # Along a row for pieces that rise, along a column for flat ones.
    middles = named.select("fid", "id", "flat", F.when(F.col("flat"), mx).otherwise(my).alias("u"), F.when(F.col("flat"), my).otherwise(mx).alias("v"))
    lines = [named.select("fid", F.lit(flat).alias("flat"), F.col(f"a{u}").alias("u1"), F.col(f"b{u}").alias("u2"), F.col(f"a{v}").alias("v1"), F.col(f"b{v}").alias("v2")) for flat, u, v in ((False, "y", "x"), (True, "x", "y"))]
    bands = lines[0].unionByName(lines[1]).where("u1 <> u2").withColumn("band", _squares(F.col("u1"), F.col("u2"), cell))
    met = middles.withColumn("band", F.floor(F.col("u") / cell)).join(bands, ["fid", "flat", "band"])
    before = ((F.col("u1") > F.col("u")) != (F.col("u2") > F.col("u"))) & (F.col("v1") + (F.col("u") - F.col("u1")) / (F.col("u2") - F.col("u1")) * (F.col("v2") - F.col("v1")) < F.col("v") - 10.0 ** -(DIGITS + 1))
    odd = met.groupBy("id").agg((F.sum(F.when(before, 1).otherwise(0)) % 2 == 1).alias("inside"))
    # Inside lies before the middle: left of a piece that rises, below a flat one. The lesser end has the lesser x.
    up = F.col("by") > F.col("ay")
    keep = F.when(F.col("flat"), ~F.col("inside")).otherwise(F.col("inside") == up)
    swap = lambda one, two, name: F.when(keep, F.col(one)).otherwise(F.col(two)).alias(name)
    return named.join(odd, "id").select("id", "fid", swap("ax", "bx", "ax"), swap("ay", "by", "ay"), swap("bx", "ax", "bx"), swap("by", "ay", "by"))


def _traced(turned: DataFrame) -> DataFrame:
    """fid, cycle, vidx, x, y: closed rings with their region on the left."""
    angle = lambda x, y: F.atan2(y, x)
    arriving = turned.select("fid", "id", F.col("bx").alias("x"), F.col("by").alias("y"), angle(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("back"))
    leaving = turned.select("fid", F.col("id").alias("ptr"), F.col("ax").alias("x"), F.col("ay").alias("y"), angle(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("out"))
    turn = F.pmod(F.col("back") - F.col("out"), F.lit(6.283185307179586))
    turn = F.when(turn < 1e-12, F.lit(6.283185307179586)).otherwise(turn)
    follow = arriving.join(leaving, ["fid", "x", "y"]).groupBy("id").agg(F.min_by("ptr", F.struct(turn, "ptr")).alias("ptr"))
    placed = graphs.cycle_places(cut(follow.select(F.col("id").alias("node"), "ptr"), "follow"))
    met = turned.join(placed, turned["id"] == placed["node"])
    n = F.count("*").over(Window.partitionBy("fid", "cycle"))
    spots = F.when(F.col("place") == 0, F.array(F.lit(0).cast("long"), F.col("n"))).otherwise(F.array("place"))
    return met.withColumn("n", n).select("fid", "cycle", F.explode(spots).alias("vidx"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def repaired(rings: DataFrame, cell: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """(rings in long form, fid and message of those that were repaired).

    Polygons (fid, part, ring, vidx, x, y; closed) whose edges meet other than at common ends of two
    are replaced by the region of the even-odd rule: outsides turn left and are ring 0 of a part,
    holes follow their outside. What has no region at all is left as it is, for the other checks.
    """
    edges = cut(_edges(rings), "edges")
    met = cut(meetings(edges, cell), "meetings")
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    # Edges that lie on each other exactly are not met inside; they show as repeated.
    twice = edges.groupBy("fid", F.least(end("ax", "ay"), end("bx", "by")).alias("p"), F.greatest(end("ax", "ay"), end("bx", "by")).alias("q")).agg(F.count("*").alias("n")).where("n > 1")
    faulty = cut(met.select("fid").unionByName(twice.select("fid")).distinct(), "faulty")
    none = faulty.select("fid", F.lit("geometry repaired").alias("message"))
    if faulty.isEmpty():
        return rings.select("fid", "part", "ring", "vidx", "x", "y"), none
    traced = cut(_traced(_turned(_pieces(edges.join(faulty, "fid", "left_semi"), met), cell)), "traced")
    w = Window.partitionBy("fid", "cycle").orderBy("vidx")
    cross = F.col("x") * F.lead("y").over(w) - F.lead("x").over(w) * F.col("y")
    areas = cut(traced.withColumn("c", cross).groupBy("fid", "cycle").agg((F.sum("c") / 2).alias("area"), F.min_by(F.struct("x", "y"), "vidx").alias("a"), F.max_by(F.struct("x", "y"), F.when(F.col("vidx") == 1, 1).otherwise(0)).alias("b")), "areas")
    outer = traced.join(areas.where("area > 0").select("cycle"), "cycle").select(F.col("cycle").alias("fid"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "vidx", "x", "y")
    # A hole's first edge has its region on the left: a place beside it lies in its outside.
    holes = areas.where("area < 0")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    tiny = 1e-3
    beside = holes.select("fid", "cycle", ((F.col("a.x") + F.col("b.x")) / 2 - tiny * dy).alias("x"), ((F.col("a.y") + F.col("b.y")) / 2 + tiny * dx).alias("y")).withColumnRenamed("fid", "polygon")
    within = grid.point_in_rings(beside, outer, cell).select(F.col("polygon").alias("fid"), "cycle", F.col("fid").alias("outside"))
    own = within.join(areas.select("fid", F.col("cycle").alias("outside"), F.col("area").alias("size")), ["fid", "outside"]).groupBy("fid", "cycle").agg(F.min_by("outside", "size").alias("part"))
    order = Window.partitionBy("fid", "part").orderBy("cycle")
    named = areas.where("area > 0").select("fid", "cycle", F.col("cycle").alias("part"), F.lit(0).alias("ring")).unionByName(own.withColumn("ring", F.row_number().over(order)).select("fid", "cycle", "part", "ring"))
    numbers = named.withColumn("part", (F.dense_rank().over(Window.partitionBy("fid").orderBy("part")) - 1).cast("int"))
    new = traced.join(numbers, ["fid", "cycle"]).select("fid", "part", "ring", "vidx", "x", "y")
    done = new.select("fid").distinct()
    kept = rings.join(done, "fid", "left_anti").select("fid", "part", "ring", F.col("vidx").cast("long").alias("vidx"), "x", "y")
    return kept.unionByName(new), none.join(done, "fid", "left_semi")
