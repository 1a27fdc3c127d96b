import random
import sys

from pyspark.sql import functions as F

from thalweg.operators import network


def reference(lengths, ups):
    """Recursion over the whole network, cut where a segment is met on its own way up."""
    found = {}

    def weight(i, visiting):
        if i in found:
            return found[i]
        if i in visiting:
            return lengths[i]
        visiting.add(i)
        found[i] = lengths[i] + max((weight(u, visiting) for u in sorted(ups.get(i, []))), default=0.0)
        return found[i]

    for i in sorted(lengths):
        weight(i, set())
    return found


def compare(spark, networks):
    segments = [(b, i, x) for b, (lengths, _) in networks.items() for i, x in lengths.items()]
    links = [(b, i, u) for b, (_, ups) in networks.items() for i, us in ups.items() for u in us]
    got = network.weights(
        spark.createDataFrame(segments, "basin_id long, seg_id long, len_m double"), spark.createDataFrame(links, "basin_id long, seg_id long, up_seg_id long")
    ).collect()
    want = {(b, i): w for b, (lengths, ups) in networks.items() for i, w in reference(lengths, ups).items()}
    assert len(got) == len(want) and {(r["basin_id"], r["seg_id"]): r["weight"] for r in got} == want


def test_long_paths_branches_and_cycles(spark):
    sys.setrecursionlimit(5000)
    deep = {i: float(i % 7 + 1) for i in range(320)} | {1000 + i: float(i % 50) for i in range(0, 320, 3)}
    stem = {i: [i + 1] + ([1000 + i] if i % 3 == 0 else []) for i in range(319)}
    braided = {i: float(i + 1) for i in range(8)}, {0: [1, 2], 1: [3], 2: [3, 4], 3: [5, 6], 4: [6], 6: [7]}
    # 3, 4 and 5 form a cycle fed by 6; 0 to 2 lie below it.
    looped = {i: float(10 - i) for i in range(7)}, {0: [1], 1: [2], 2: [4], 3: [5, 6], 4: [3], 5: [4]}
    compare(spark, {1: (deep, stem), 2: braided, 3: looped, 4: ({1: 2.0}, {})})


def test_snapping_looks_across_squares_and_broadcasts_nothing(spark):
    """Ends on either side of squares' borders, at negative places and at the distance itself, against every pair."""
    rows = [(1, i, (i * 7 % 23) * 0.5 - 6.0, (i * 5 % 19) * 0.5 - 5.0, (i * 11 % 29) * 0.5 - 7.0, (i * 3 % 17) * 0.5 - 4.0) for i in range(60)]
    found = network.snapped(spark.createDataFrame(rows, "basin_id long, seg_id long, start_x double, start_y double, end_x double, end_y double"), 2.0)
    got = found.agg(F.sort_array(F.collect_list(F.struct("seg_id", "up_seg_id"))).alias("links"))
    (links,) = got.collect()
    assert [tuple(r) for r in links["links"]] == sorted((a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and (a[2] - b[4]) ** 2 + (a[3] - b[5]) ** 2 <= 4)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


PLACED = "basin_id long, seg_id long, start_x double, start_y double, end_x double, end_y double, len_m double"


def test_places_give_what_pairs_give(spark):
    """Streams that share their places, with cycles, closed ones and ones below both, against every pair."""
    draw, rows = random.Random(5), []
    for basin in range(12):
        spots = [(draw.randrange(30) * 3.0, draw.randrange(30) * 3.0) for _ in range(6 + 5 * basin)]
        for i in range(8 * (basin + 1)):
            # Basins under 6 mostly run from later to earlier spots, so parts of them are without cycles.
            a, b = (draw.randrange(len(spots)) for _ in range(2))
            if basin < 6 and draw.random() < 0.9:
                a, b = max(a, b), min(a, b)
            off = draw.choice([0.0, 0.5, 2.0])
            rows.append((basin, i * 7 + 3, *spots[a], spots[b][0] + off, spots[b][1], float(draw.randrange(1, 60))))
    segments = spark.createDataFrame(rows, PLACED)
    ups = {(r[0], r[1]): [u[1] for u in rows if u[0] == r[0] and u[1] != r[1] and (r[2] - u[4]) ** 2 + (r[3] - u[5]) ** 2 <= 4] for r in rows}
    want, rivers = {}, {}
    for b in range(12):
        weight = reference({r[1]: r[6] for r in rows if r[0] == b}, {i: u for (c, i), u in ups.items() if c == b})
        want |= {(b, i): w for i, w in weight.items()}
        at, way = max(weight, key=lambda i: (weight[i], -i)), []
        while at is not None and at not in way:
            way.append(at)
            at = max(ups[b, at], key=lambda i: (weight[i], -i), default=None)
        rivers[b] = way
    placed, near = network.places(segments)
    got = network.place_weights(placed, near).collect()
    assert len(got) == len(want) and {(r["basin_id"], r["seg_id"]): r["weight"] for r in got} == want
    river = network.place_river(placed, near).orderBy("basin_id", "place").collect()
    assert {b: [r["seg_id"] for r in river if r["basin_id"] == b] for b in range(12)} == rivers
    assert any(len(set(u)) and i in u2 for (b, i), u in ups.items() for u2 in [ups[b, x] for x in u])


def test_links_of_places_do_not_grow_with_their_copies(spark):
    """A hundred streams along each of eight reaches in a circle: 80,000 pairs of them, as many links as for one along each."""
    ring = [(100.0 * i, 0.0, 100.0 * ((i + 1) % 8) + 0.5, 0.5) for i in range(8)]
    counts = []
    for copies in (1, 100):
        rows = [(1, i, *ring[i % 8], 10.0 + i % 3) for i in range(8 * copies)]
        placed, near = network.places(spark.createDataFrame(rows, PLACED))
        counts.append((near.count(), placed.count(), network.place_weights(placed, near).count()))
    assert counts == [(8, 8, 8), (8, 800, 800)]
