"""Stream networks: orientation, snapping of ends, main rivers, and clipping to rectangles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_merged as cut


def downhill(segments: DataFrame) -> DataFrame:
    """Segments turned so that they start at the higher end (z_start, z_end; unknown counts as -9999)."""
    z0, z1 = F.coalesce("z_start", F.lit(-9999.0)), F.coalesce("z_end", F.lit(-9999.0))
    turn = z0 < z1
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    pairs = {"start_x": "end_x", "start_y": "end_y", "z_start": "z_end"}
    both = pairs | {b: a for a, b in pairs.items()}
    return segments.select(*[swap(c, both[c]) if c in both else F.col(c) for c in segments.columns], turn.alias("turned"))


def snapped(segments: DataFrame, distance: float = 2.0) -> DataFrame:
    """basin_id, seg_id, up_seg_id: segments whose end lies within ``distance`` of another's start."""
    ends = segments.select("basin_id", F.col("seg_id").alias("up_seg_id"), "end_x", "end_y")
    met = _within(segments.select("basin_id", "seg_id", "start_x", "start_y"), ends, distance)
    return met.where("seg_id <> up_seg_id").select("basin_id", "seg_id", "up_seg_id")


def _within(starts: DataFrame, ends: DataFrame, distance: float) -> DataFrame:
    """Pairs of starts and ends of a basin that lie within ``distance``.

    Starts look into the squares, four times as wide, that they reach: one to four, two on average. An equi-join and a check;
    the squares are sized before they are expanded, so without the hint they might be broadcast.
    """
    square = lambda c: F.floor(c / (4 * distance))
    # A little further than the distance, for ends that rounding would put into the next square.
    reach = lambda c: F.explode(F.sequence(square(F.col(c) - distance * 1.001), square(F.col(c) + distance * 1.001)))
    ends = ends.withColumn("bx", square(F.col("end_x"))).withColumn("by", square(F.col("end_y")))
    starts = starts.withColumn("bx", reach("start_x")).withColumn("by", reach("start_y"))
    met = starts.hint("merge").join(ends, ["basin_id", "bx", "by"])
    return met.where((F.col("start_x") - F.col("end_x")) ** 2 + (F.col("start_y") - F.col("end_y")) ** 2 <= distance**2).drop("bx", "by")


def places(segments: DataFrame, distance: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(``segments`` with ``start`` and ``end``, their places; near: basin_id, start, end of places within ``distance``).

    Whatever starts, or ends, at one place is one there, so links grow with the different places and
    not with the pairs of streams that share them. A place has the smallest seg_id of those that start, or end, there.
    """
    at = lambda side: ["basin_id", f"{side}_x", f"{side}_y"]
    starts, ends = (cut(segments.groupBy(*at(side)).agg(F.min("seg_id").alias(side)), "places") for side in ("start", "end"))
    near = cut(_within(starts, ends, distance).select("basin_id", "start", "end"), "links")
    placed = segments.join(starts, at("start")).join(ends, at("end")).select(*segments.columns, "start", "end")
    return cut(placed, "placed"), near


def weights(segments: DataFrame, links: DataFrame) -> DataFrame:
    """basin_id, seg_id, weight: the longest way up from each segment, itself included.

    Segments on cycles, or below them, are walked as the reference does (``_cut_cycles``).
    """
    key = ["basin_id", "seg_id"]
    own = cut(segments.select(*key, F.col("len_m").cast("double").alias("len_m")), "segments")
    open_links = links.select(*key, "up_seg_id").distinct().join(_above(own), ["basin_id", "up_seg_id"], "left_semi")
    every = cut(open_links.join(own, key).select(*key, "up_seg_id", F.col("len_m").alias("d")), "links")
    known, rest = _longest(own.withColumnRenamed("len_m", "c"), every)
    if rest.isEmpty():
        return known
    return known.unionByName(_cut_cycles(rest.join(own, key), every, known))


def _above(df: DataFrame, *rest: str | Column) -> DataFrame:
    return df.select("basin_id", F.col("seg_id").alias("up_seg_id"), *rest)


def _longest(own: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(basin_id, seg_id, weight; basin_id, seg_id of those on cycles or below them).

    The weight of a node: the most of ``c`` (of ``own``) and, over its links (``every``), d + the
    weight above. Nodes without open links are done and pass their weight down; a link to a node with
    one open link is drawn on to that one's upstream node, so a path of any length takes about log2
    rounds. Every round ends a node unless only those on cycles, or below them, are left.
    """
    key, above = ["basin_id", "seg_id"], _above
    edges, nodes, done = every, own, []
    more = lambda gain: cut(nodes.join(gain, key, "left").select(*key, F.greatest("c", "g").alias("c")), "nodes")
    for _ in range(own.count() + 1):
        now = cut(nodes.join(edges.select(*key).distinct(), key, "left_anti").select(*key, F.col("c").alias("weight")), "done")
        if now.isEmpty():
            break
        done.append(now)
        met = cut(edges.join(above(now, "weight", F.lit(True).alias("ready")), ["basin_id", "up_seg_id"], "left"), "met")
        nodes = nodes.join(edges.select(*key).distinct(), key, "left_semi")
        nodes = more(met.where("ready").groupBy(*key).agg(F.max(F.col("weight") + F.col("d")).alias("g")))
        rest = met.where("ready is null").select(*key, "up_seg_id", "d")
        single = rest.groupBy(*key).agg(F.count("*").alias("n"), F.max("up_seg_id").alias("next"), F.max("d").alias("d2")).where("n = 1").join(nodes, key)
        met = cut(rest.join(above(single, "next", "d2", F.col("c").alias("cu")), ["basin_id", "up_seg_id"], "left"), "met")
        nodes = more(met.where("next is not null").groupBy(*key).agg(F.max(F.col("cu") + F.col("d")).alias("g")))
        drawn = met.select(*key, F.coalesce("next", "up_seg_id").alias("up_seg_id"), F.when(F.col("next").isNotNull(), F.col("d") + F.col("d2")).otherwise(F.col("d")).alias("d"))
        edges = cut(drawn.groupBy(*key, "up_seg_id").agg(F.max("d").alias("d")), "links")
    else:
        raise RuntimeError("river weights did not settle")
    return reduce(DataFrame.unionByName, done, own.select(*key, F.col("c").alias("weight")).limit(0)), nodes.select(*key)


def place_weights(segments: DataFrame, near: DataFrame) -> DataFrame:
    """``weights`` of segments between places (start, end), by the links ``near`` of these: no pair of segments is made.

    All that starts at a place has the same way up, so the places are solved first; those on cycles,
    below them or with a segment back to themselves are walked by segment.
    """
    key = ["basin_id", "seg_id"]
    own = cut(segments.select(*key, "start", "end", F.col("len_m").cast("double").alias("len_m")), "segments")
    longest = own.groupBy("basin_id", "end", F.col("start").alias("up_seg_id")).agg(F.max("len_m").alias("d"))
    met = near.join(longest, ["basin_id", "end"]).groupBy("basin_id", F.col("start").alias("seg_id"), "up_seg_id").agg(F.max("d").alias("d"))
    starts = cut(own.select("basin_id", F.col("start").alias("seg_id")).distinct().withColumn("c", F.lit(0.0)), "nodes")
    done, left = _longest(starts, cut(met, "links"))
    up = done.select("basin_id", F.col("seg_id").alias("start"), "weight")
    known = cut(own.join(up, ["basin_id", "start"]).select(*key, "end", (F.col("len_m") + F.col("weight")).alias("weight")), "known")
    found = known.select(*key, "weight")
    if left.isEmpty():
        return found
    at = left.select("basin_id", F.col("seg_id").alias("start"))
    links = near.join(at, ["basin_id", "start"], "left_semi")
    most = known.groupBy("basin_id", "end").agg(F.max("weight").alias("len_m"))
    kind = lambda name: F.lit(name).alias("kind")
    none = F.lit(-1).cast("long")
    parts = [
        own.join(at, ["basin_id", "start"], "left_semi").select(kind("segment"), *key, "start", "end", "len_m"),
        links.select(kind("link"), "basin_id", none.alias("seg_id"), "start", "end", F.lit(0.0).alias("len_m")),
        most.join(links.select("basin_id", "end").distinct(), ["basin_id", "end"], "left_semi").select(kind("known"), "basin_id", none.alias("seg_id"), none.alias("start"), "end", "len_m"),
    ]
    return found.unionByName(reduce(DataFrame.unionByName, parts).groupBy("basin_id").applyInPandas(_walked, found.schema))


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """``_cut_cycles`` for a basin's segments between places, its links of places, and the most weight known at each end.

    The next segment up from a place is the least unvisited of those that end near it. What is
    finished counts its weight, what is on the way (a stack for each end) its length. So the work
    grows with the segments, whatever the pairs of them.
    """
    rows = rows.assign(end=pd.factorize(rows["end"])[0])
    own, links, known = (rows[rows["kind"] == kind] for kind in ("segment", "link", "known"))
    own = own.sort_values("seg_id", ignore_index=True)
    most = np.full(int(rows["end"].max()) + 1, -np.inf)
    most[known["end"]] = known["len_m"]
    near = {p: ends.to_numpy() for p, ends in links.groupby("start")["end"]}
    nowhere = np.empty(0, "int64")
    start, end, length = own["start"].tolist(), own["end"].tolist(), own["len_m"].tolist()
    at_end = {e: i.tolist() for e, i in own.groupby("end").groups.items()}
    nobody, n = len(own), len(most)
    head, place, top, inside = np.full(n, nobody), [0] * n, np.full(n, -np.inf), [[] for _ in range(n)]
    for e, i in at_end.items():
        head[e] = i[0]
    seen, weight = [False] * nobody, [0.0] * nobody

    def enter(i: int) -> None:
        seen[i], e = True, end[i]
        way.append(i)
        inside[e].append(max(length[i], top[e]))
        top[e] = inside[e][-1]
        at, k = at_end[e], place[e]
        while k < len(at) and seen[at[k]]:
            k += 1
        place[e], head[e] = k, at[k] if k < len(at) else nobody

    way: list[int] = []
    for first in range(nobody):
        if not seen[first]:
            enter(first)
        while way:
            i = way[-1]
            ends = near.get(start[i], nowhere)
            if (up := int(head[ends].min(initial=nobody))) < nobody:
                enter(up)
                continue
            e = end[way.pop()]
            inside[e].pop()
            top[e] = inside[e][-1] if inside[e] else -np.inf
            best = float(max(most[ends].max(initial=-np.inf), top[ends].max(initial=-np.inf)))
            weight[i] = length[i] + (best if best > -np.inf else 0.0)
            most[e] = max(most[e], weight[i])
    return own[["basin_id", "seg_id"]].assign(weight=weight)


def _cut_cycles(rest: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """Weights of segments on cycles or below them: depth first by seg_id, a segment that is met on its own way up counts its length only.

    The result depends on that order, so a basin's part of such segments is walked as one group.
    """
    key = ["basin_id", "seg_id"]
    state = known.select("basin_id", F.col("seg_id").alias("up_seg_id"), "weight", F.lit(True).alias("ready"))
    met = links.join(rest.select(*key), key, "left_semi").join(state, ["basin_id", "up_seg_id"], "left")
    ups = met.groupBy(*key).agg(F.max("weight").alias("most"), F.sort_array(F.collect_list(F.when(F.col("ready").isNull(), F.col("up_seg_id")))).alias("ups"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_id")
        length, most, up = (dict(zip(pdf["seg_id"], pdf[c])) for c in ("len_m", "most", "ups"))
        found: dict[int, float] = {}
        for first in pdf["seg_id"]:
            way, inside = [], set()
            if first not in found:
                way, inside = [[first, 0, most[first]]], {first}
            while way:
                at, i, best = way[-1]
                if i < len(up[at]):
                    u = up[at][i]
                    if u not in found and u not in inside:
                        inside.add(u)
                        way.append([u, 0, most[u]])
                        continue
                    w = found[u] if u in found else length[u]
                    way[-1][1:] = [i + 1, w if best != best or w > best else best]
                else:
                    found[at] = length[at] + (0.0 if best != best else best)
                    way.pop()
        return pdf[["basin_id", "seg_id"]].assign(weight=pdf["seg_id"].map(found))

    rows = rest.join(ups, key).withColumn("most", F.coalesce("most", F.lit(float("nan"))))
    return rows.groupBy("basin_id").applyInPandas(walk, known.schema)


def main_river(segments: DataFrame, links: DataFrame, weighed: DataFrame | None = None, limit: int = 64) -> DataFrame:
    """basin_id, place, seg_id, length_m: from the mouth (place 0) up the heaviest segments; ties go to the smallest id.

    Every segment points to its heaviest upstream one; the pointers are doubled, and what each
    reaches from the basin's outlet is the river.
    """
    w = cut(weights(segments, links) if weighed is None else weighed, "weighed")
    above = links.join(w.withColumnRenamed("seg_id", "up_seg_id"), ["basin_id", "up_seg_id"])
    best = above.groupBy("basin_id", "seg_id").agg(F.max_by("up_seg_id", F.struct("weight", -F.col("up_seg_id"))).alias("next"))
    return _followed(w, best, limit)


def place_river(segments: DataFrame, near: DataFrame, limit: int = 64) -> DataFrame:
    """``main_river`` of segments between places (start, end), by the links ``near`` of these.

    A segment that is the heaviest near its own start goes on to the second there.
    """
    w = cut(place_weights(segments, near), "weighed")
    rank = F.struct("weight", (-F.col("seg_id")).alias("less"))
    ends = segments.select("basin_id", "seg_id", "end").join(w, ["basin_id", "seg_id"]).select("basin_id", "end", rank.alias("one"))
    two = _two(near.join(cut(_two(ends, "end"), "ends"), ["basin_id", "end"]), "start")
    chosen = F.when(F.col("one.less") != -F.col("seg_id"), F.col("one.less")).otherwise(F.col("two.less"))
    best = segments.select("basin_id", "seg_id", "start").join(two, ["basin_id", "start"]).select("basin_id", "seg_id", (-chosen).alias("next")).where("next is not null")
    return _followed(w, best, limit)


def _two(ranked: DataFrame, at: str) -> DataFrame:
    """basin_id, ``at``, one, two: the first and the second of what ``ranked`` has there (one, and two where it has that)."""
    if "two" in ranked.columns:
        ranked = ranked.select("basin_id", at, F.explode(F.array_compact(F.array("one", "two"))).alias("one"))
    first = ranked.groupBy("basin_id", at).agg(F.max("one").alias("one"))
    other = ranked.withColumnRenamed("one", "two").join(first, ["basin_id", at]).where("two <> one").groupBy("basin_id", at).agg(F.max("two").alias("two"))
    return first.join(other, ["basin_id", at], "left")


def _followed(w: DataFrame, best: DataFrame, limit: int) -> DataFrame:
    """The river of each basin by the weights and each segment's upstream one (``next``)."""
    hop = cut(best, "hops")
    outlet = w.groupBy("basin_id").agg(F.max_by("seg_id", F.struct("weight", -F.col("seg_id"))).alias("seg_id"), F.max("weight").alias("length_m"))
    seen = cut(outlet.select("basin_id", "seg_id", F.lit(0).cast("long").alias("place")), "river")
    length, n = 1, seen.count()
    for _ in range(limit):
        new = seen.join(hop, ["basin_id", "seg_id"]).select("basin_id", F.col("next").alias("seg_id"), (F.col("place") + length).alias("place"))
        seen = cut(seen.unionByName(new).groupBy("basin_id", "seg_id").agg(F.min("place").alias("place")), "river")
        if (now := seen.count()) == n:
            break
        n = now
        hop = cut(hop.alias("a").join(hop.alias("b"), (F.col("a.basin_id") == F.col("b.basin_id")) & (F.col("a.next") == F.col("b.seg_id"))).select("a.basin_id", "a.seg_id", "b.next"), "hops")
        length *= 2
    return seen.join(outlet.select("basin_id", "length_m"), "basin_id").select("basin_id", "place", "seg_id", F.round("length_m", 2).alias("length_m"))


def clipped(segments: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Segments (seg_id, x1, y1, x2, y2) cut to rectangles (fid, x_min, x_max, y_min, y_max), by parametric clipping.

    Both sides go to the squares of size ``cell`` that their bounding boxes touch; pairs that meet
    in several squares are cut once.
    """
    tile = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    s = segments.withColumn("tx", F.explode(tile(F.least("x1", "x2"), F.greatest("x1", "x2")))).withColumn("ty", F.explode(tile(F.least("y1", "y2"), F.greatest("y1", "y2"))))
    b = boxes.withColumn("tx", F.explode(tile(F.col("x_min"), F.col("x_max")))).withColumn("ty", F.explode(tile(F.col("y_min"), F.col("y_max"))))
    met = s.join(b, ["tx", "ty"]).drop("tx", "ty").dropDuplicates(["seg_id", "fid"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    lows, highs, keep = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for d, at, lo, hi in ((dx, "x1", "x_min", "x_max"), (dy, "y1", "y_min", "y_max")):
        a, c = F.try_divide(F.col(lo) - F.col(at), d), F.try_divide(F.col(hi) - F.col(at), d)
        lows.append(F.coalesce(F.least(a, c), F.lit(0.0)))
        highs.append(F.coalesce(F.greatest(a, c), F.lit(1.0)))
        keep = keep & ((d != 0) | F.col(at).between(F.col(lo), F.col(hi)))
    cutted = met.withColumn("t0", F.greatest(*lows)).withColumn("t1", F.least(*highs)).where(keep & (F.col("t0") < F.col("t1")))
    on = lambda p, d, t: F.col(p) + F.col(t) * d
    return cutted.select("seg_id", "fid", on("x1", dx, "t0").alias("x1"), on("y1", dy, "t0").alias("y1"), on("x1", dx, "t1").alias("x2"), on("y1", dy, "t1").alias("y2"))


def without_stream(basins: DataFrame, parts: DataFrame) -> DataFrame:
    """fid and reason of basins that no segment crosses."""
    return basins.select("fid").join(parts.select("fid").distinct(), "fid", "left_anti").withColumn("reason", F.lit("no stream found in basin"))


