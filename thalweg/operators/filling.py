"""Flow directions from elevations: depressions are filled to their spill level and flats drain to where they end, tile by tile.

A cell's filled level is the lowest that the highest cell of a way to the outside can be; the
outside is what lies beyond the grid's edge and in cells without a value.

1. A tile is solved on its own, from its border cells and its cells beside the outside: every cell has
   the one that it reaches lowest, and the level it takes. Where the regions of two such cells
   touch, they are linked at the lowest level of a passage; border cells of two tiles are linked where they touch.
2. This graph of border cells, far smaller than the grid, is solved by merging: each region joins
   the neighbour behind its lowest passage, all at once, so the rounds grow with the logarithm of the regions.
3. A second pass over the tiles has the levels. A cell drains to its steepest lower neighbour. Cells of
   a flat drain along the fewest steps to a cell of it that has a lower neighbour or lies beside the
   outside. Only flats that cross tiles take further rounds, one for each border on such a way.

The grid is shuffled twice. The result depends on elevations alone, not on the tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, cut_merged
from .tiles import SIDE

OUTSIDE = -1
#: (row step, column step) of the eight neighbours, in the order of cell numbers.
STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def merged_levels(u: np.ndarray, v: np.ndarray, w: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, source) of each node of a graph: the lowest maximum of edges on a way to a source, and the source.

    Each region without a source joins the neighbour behind its lowest edge, until all have one.
    Sources have level -inf; nodes without a way to one have the source -1.
    """
    n = len(sources)
    order = np.argsort(w, kind="stable")  # an edge's rank is its weight, without ties
    u, v, w = u[order], v[order], w[order]
    region, level, open_ = np.arange(n), np.full(n, -np.inf), ~sources
    rank = np.arange(len(w))
    while True:
        a, b = region[u[rank]], region[v[rank]]
        useful = (a != b) & (open_[a] | open_[b])
        rank, a, b = rank[useful], a[useful], b[useful]
        if not len(rank):
            break
        best = np.full(n, len(w))
        # Ranks ascend: of repeated places the first one written last holds, so write from the end.
        best[a[::-1]] = rank[::-1]
        other = np.full(n, len(w))
        other[b[::-1]] = rank[::-1]
        best = np.where(open_, np.minimum(best, other), len(w))
        hooked = np.flatnonzero(best < len(w))
        ends = region[u[best[hooked]]], region[v[best[hooked]]]
        ptr = np.arange(n)
        ptr[hooked] = np.where(ends[0] == hooked, ends[1], ends[0])
        twice = ptr[ptr[hooked]] == hooked  # two regions that chose the same edge
        ptr[hooked[twice & (hooked < ptr[hooked])]] = hooked[twice & (hooked < ptr[hooked])]
        taken = np.append(w, -np.inf)[best]
        level = np.maximum(level, taken[region])
        while True:
            further = ptr[ptr]
            if (further == ptr).all():
                break
            ptr = further
        region = ptr[region]
    return level, np.where(sources[region], region, -1)


class Tile:
    """A tile's cells in a square with a rim of one cell; NaN where there is none."""

    def __init__(self, key: tuple, n_cols: int, side: int, src: np.ndarray, value: np.ndarray):
        self.n_cols, self.side = n_cols, side
        self.top, self.left = int(key[0]) * side - 1, int(key[1]) * side - 1
        self.z = np.full((side + 2, side + 2), np.nan)
        self.put(self.z, src, value)

    def at(self, src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return src // self.n_cols - self.top, src % self.n_cols - self.left

    def put(self, grid: np.ndarray, src: np.ndarray, value: np.ndarray) -> None:
        grid[self.at(src)] = value

    def cells(self, mask: np.ndarray) -> np.ndarray:
        """Numbers of the inner cells of ``mask``, and of the rim's."""
        r, c = np.nonzero(mask)
        return (r + self.top) * self.n_cols + c + self.left

    def inner(self) -> np.ndarray:
        """Cells of the tile itself."""
        out = np.zeros(self.z.shape, bool)
        out[1:-1, 1:-1] = ~np.isnan(self.z[1:-1, 1:-1])
        return out

    def border(self) -> np.ndarray:
        out = self.inner()
        out[2:-2, 2:-2] = False
        return out


def shifted(grid: np.ndarray, step: tuple[int, int], beyond) -> np.ndarray:
    """What each cell's neighbour at ``step`` has."""
    out = np.full_like(grid, beyond)
    h, w = grid.shape
    dr, dc = step
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = grid[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)]
    return out


def spread(steps: np.ndarray, level: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Least steps of the cells ``open_`` from those with steps (inf for none), between neighbours of one level."""
    out, height, free = steps.ravel().copy(), level.ravel(), open_.ravel()
    width = steps.shape[1]
    moves = np.array([dr * width + dc for dr, dc in STEPS])
    start = np.flatnonzero(np.isfinite(out))
    start = start[np.argsort(out[start], kind="stable")]
    at, front, now = 0, start[:0], 0.0
    while at < len(start) or len(front):
        if not len(front):
            now = out[start[at]]
        stop = np.searchsorted(out[start], now, side="right") if at < len(start) else at
        begin = start[at:stop]
        at = max(at, stop)
        here = np.concatenate([front, begin[out[begin] == now]])
        near = here[:, None] + moves
        fit = (near >= 0) & (near < len(out))
        near = np.where(fit, near, 0)
        fit &= free[near] & (height[near] == height[here][:, None]) & (out[near] > now + 1)
        front = np.unique(near[fit])
        out[front] = now + 1
        now += 1
    return out.reshape(steps.shape)


def steepest(t: Tile, px: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest drop for each unit of distance, the neighbour there, whether a cell lies beside the outside); equal drops go to the smaller number."""
    number = (np.arange(t.z.shape[0])[:, None] + t.top) * t.n_cols + np.arange(t.z.shape[1])[None, :] + t.left
    best, dst, beside = np.zeros(t.z.shape), number.copy(), np.zeros(t.z.shape, bool)
    for dr, dc in STEPS:
        near = shifted(t.z, (dr, dc), np.nan)
        beside |= np.isnan(near)
        drop = (t.z - near) / math.hypot(dr * px[1], dc * px[0])
        better = drop > best
        best[better] = drop[better]
        dst[better] = number[better] + dr * t.n_cols + dc
    return best, dst, beside


def along(t: Tile, dst: np.ndarray, flat: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """``dst`` with flat cells draining to their neighbour of one level that is a step nearer, the smaller number of several."""
    out, open_ = dst.copy(), flat.copy()
    number = (np.arange(t.z.shape[0])[:, None] + t.top) * t.n_cols + np.arange(t.z.shape[1])[None, :] + t.left
    for dr, dc in STEPS:
        nearer = open_ & (shifted(t.z, (dr, dc), np.nan) == t.z) & (shifted(steps, (dr, dc), np.inf) == steps - 1)
        out[nearer] = number[nearer] + dr * t.n_cols + dc
        open_ &= ~nearer
    return out


def touching(t: Tile, flat: np.ndarray) -> np.ndarray:
    """Cells beside a cell of another tile at their own level."""
    rim = t.z.copy()
    rim[1:-1, 1:-1] = np.nan
    out = np.zeros(flat.shape, bool)
    for step in STEPS:
        out |= flat & (shifted(rim, step, np.nan) == t.z)
    return out


_TILED = "kind int, ty long, tx long, src long, other long, level double"
_CELL, _LINK, _RIM = 0, 1, 2


def _key(cell: Column, n_cols: int, side: int) -> tuple[Column, Column]:
    return F.floor(F.floor(cell / n_cols) / side), F.floor((cell % n_cols) / side)


def regions(cells: DataFrame, n_cols: int, side: int) -> DataFrame:
    """Of each tile: its cells (src, other the cell reached lowest, level), links (src, other, level) between those, and border cells (src, level)."""

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        t = Tile(key, n_cols, side, group["src"].to_numpy(np.int64), group["z"].to_numpy(np.float64))
        inner, border = t.inner(), t.border()
        number = np.full(t.z.shape, -1)
        number[inner] = np.arange(int(inner.sum()))
        pairs = []
        for dr, dc in STEPS[4:]:  # each pair of neighbours once
            near = shifted(number, (dr, dc), -1)
            met = inner & (near >= 0)
            pairs.append((number[met], near[met]))
        z, src = t.z[inner], t.cells(inner)
        n = len(src)
        u, v = (np.concatenate(x) for x in zip(*pairs))
        w = np.maximum(z[u], z[v])
        # The outside is one more node; what lies beyond the tile's border is not known here.
        ocean = np.flatnonzero(_missing_within(t, number)[inner])
        u, v, w = np.append(u, ocean), np.append(v, np.full(len(ocean), n)), np.append(w, z[ocean])
        level, source = merged_levels(u, v, w, np.append(border[inner], True))
        level = np.maximum(level, np.append(z, -np.inf))
        name = np.append(src, OUTSIDE)
        a, b = name[source[u]], name[source[v]]
        apart = a != b
        link = pd.DataFrame({"src": np.maximum(a, b)[apart], "other": np.minimum(a, b)[apart], "level": np.maximum(level[u], level[v])[apart]})
        link = link.groupby(["src", "other"], as_index=False)["level"].min()
        out = [
            pd.DataFrame({"kind": _CELL, "src": src, "other": name[source[:n]], "level": level[:n]}),
            link.assign(kind=_LINK),
            pd.DataFrame({"kind": _RIM, "src": t.cells(border), "other": OUTSIDE, "level": t.z[border]}),
        ]
        found = pd.concat([x for x in out if len(x)], ignore_index=True)
        found["ty"], found["tx"] = int(key[0]), int(key[1])
        return found[[c.split()[0] for c in _TILED.split(", ")]]

    ty, tx = _key(F.col("src"), n_cols, side)
    return cells.withColumn("ty", ty).withColumn("tx", tx).groupBy("ty", "tx").applyInPandas(solve, _TILED)


def _missing_within(t: Tile, number: np.ndarray) -> np.ndarray:
    """Cells with a missing neighbour inside the tile's square."""
    inside = np.zeros(number.shape, bool)
    inside[1:-1, 1:-1] = True
    out = np.zeros(number.shape, bool)
    for step in STEPS:
        out |= shifted(inside, step, False) & (shifted(number, step, -1) < 0)
    return out


def neighbours(cells: DataFrame, n_cols: int) -> DataFrame:
    """``cells`` (src, ...) with ``near``: each of the eight neighbours, null beyond the grid's columns or above it."""
    row, col = F.floor(F.col("src") / n_cols), F.col("src") % n_cols
    step = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in STEPS]))
    each = cells.withColumn("step", step)
    r, c = row + F.col("step.dr"), col + F.col("step.dc")
    return each.withColumn("near", F.when((r >= 0) & c.between(0, n_cols - 1), r * n_cols + c)).drop("step")


def _apart(a: Column, b: Column, n_cols: int, side: int) -> Column:
    """Whether two cells are of different tiles; true where one is null."""
    (ay, ax), (by, bx) = _key(a, n_cols, side), _key(b, n_cols, side)
    return ~(ay.eqNullSafe(by) & ax.eqNullSafe(bx))


def spill_levels(links: DataFrame, limit: int = 64) -> DataFrame:
    """node, level: the lowest maximum of links (a, b, level) on a way from each node to ``OUTSIDE``.

    Regions without a way there join the neighbour behind their lowest link, ties by the nodes'
    numbers; what a region takes is the least level for all its nodes. Nodes that no way leads out of are left out.
    """
    state = cut_merged(links.select(F.explode(F.array("a", "b")).alias("node")).where(F.col("node") != OUTSIDE).distinct().select("node", F.col("node").alias("region"), F.lit(float("-inf")).alias("level")), "spills")
    open_links = cut_merged(links.select("a", "b", "level", F.struct("level", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).alias("rank")), "links")
    for _ in range(limit):
        both = open_links.select(F.col("a").alias("region"), F.col("b").alias("next"), "rank").unionByName(open_links.select(F.col("b").alias("region"), F.col("a").alias("next"), "rank"))
        chosen = both.where(F.col("region") != OUTSIDE).groupBy("region").agg(F.min(F.struct("rank", "next")).alias("c"))
        chosen = cut_merged(chosen.select("region", F.col("c.next").alias("next"), F.col("c.rank").alias("rank")), "chosen")
        if chosen.isEmpty():
            return state.where(F.col("region") == OUTSIDE).select("node", "level")
        back = chosen.select(F.col("region").alias("next"), F.col("next").alias("back"))
        # Two regions that chose the same link: the smaller one stays.
        hops = chosen.join(back, "next", "left").select("region", F.when((F.col("back") == F.col("region")) & (F.col("region") < F.col("next")), F.col("region")).otherwise(F.col("next")).alias("root"), F.col("rank.level").alias("took"))
        roots = _roots(hops, limit)
        state = cut_merged(
            state.join(roots, "region", "left").select("node", F.coalesce("root", "region").alias("region"), F.greatest("level", F.coalesce("took", F.lit(float("-inf")))).alias("level")), "spills",
        )
        to = roots.select("region", "root")
        moved = open_links.join(to.withColumnsRenamed({"region": "a", "root": "ra"}), "a", "left").join(to.withColumnsRenamed({"region": "b", "root": "rb"}), "b", "left")
        moved = moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "level", "rank").where("a <> b")
        # Of the links between two regions only the lowest can be chosen.
        least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        open_links = cut_merged(moved.groupBy(least, most).agg(F.min("rank").alias("rank")).select("a", "b", F.col("rank.level").alias("level"), "rank"), "links")
    raise ValueError("spill levels did not settle")


def _roots(hops: DataFrame, limit: int) -> DataFrame:
    """region, root, took: where following ``root`` ends, by doubling."""
    check = lambda s: tuple(s.agg(F.bit_xor(F.xxhash64("region", "root")), F.count("*")).first())
    state = cut_merged(hops, "hops")
    before = check(state)
    for _ in range(limit):
        at = state.select(F.col("region").alias("root"), F.col("root").alias("further"))
        state = cut_merged(state.join(at, "root", "left").select("region", F.coalesce("further", "root").alias("root"), "took"), "hops")
        now = check(state)
        if now == before:
            return state
        before = now
    raise ValueError("the hops have cycles")


def drained(tiled: DataFrame, levels: DataFrame, n_cols: int, side: int, px: tuple[float, float]) -> DataFrame:
    """src, dst, level, steps: where each cell drains and its filled level.

    In flats that cross tiles dst is null and ``steps`` -1; it is 0 where these may end, and null
    elsewhere. A cell that drains to the outside drains to itself.
    """
    own = tiled.where(F.col("kind") == _CELL).select("ty", "tx", "kind", "src", "other", "level")
    given = levels.select(F.col("node").alias("src"), "level")
    ty, tx = _key(F.col("src"), n_cols, side)
    source = given.select(ty.alias("ty"), tx.alias("tx"), F.lit(_LINK).alias("kind"), "src", F.lit(OUTSIDE).cast("long").alias("other"), "level")
    # The levels of border cells go to the tiles that they touch, too: their own cell is what they reach lowest.
    rim = tiled.where(F.col("kind") == _RIM).select("src", F.col("level").alias("z")).join(given.hint("merge"), "src").select("src", F.greatest("z", "level").alias("level"))
    ny, nx = _key(F.col("near"), n_cols, side)
    met = neighbours(rim, n_cols).where(F.col("near").isNotNull() & _apart(F.col("src"), F.col("near"), n_cols, side))
    rim = met.select(ny.alias("ty"), nx.alias("tx"), F.lit(_RIM).alias("kind"), "src", F.lit(OUTSIDE).cast("long").alias("other"), "level").distinct()

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind = group["kind"].to_numpy()
        cells, spills, around = (group[kind == k] for k in (_CELL, _LINK, _RIM))
        columns = ["src", "dst", "level", "steps"]
        if not len(cells):
            return pd.DataFrame({c: [] for c in columns})
        src, other = cells["src"].to_numpy(np.int64), cells["other"].to_numpy(np.int64)
        spills = spills.sort_values("src")
        names, heights = np.append(OUTSIDE, spills["src"].to_numpy(np.int64)), np.append(-np.inf, spills["level"].to_numpy(np.float64))
        t = Tile(key, n_cols, side, src, np.maximum(cells["level"].to_numpy(np.float64), heights[np.searchsorted(names, other)]))
        t.put(t.z, around["src"].to_numpy(np.int64), around["level"].to_numpy(np.float64))
        inner = t.inner()
        drop, dst, beside = steepest(t, px)
        flat = inner & (drop <= 0) & ~beside
        ends = inner & ~flat
        # Flats that reach another tile are left open, with the cells that they or their other parts may end at.
        reach = spread(np.where(touching(t, flat), 0.0, np.inf), t.z, flat)
        wide = flat & np.isfinite(reach)
        near_wide = ends & (spread(np.where(wide, 0.0, np.inf), t.z, ends) == 1)
        steps = spread(np.where(ends, 0.0, np.inf), t.z, flat & ~wide)
        dst = along(t, dst, flat & ~wide, steps)
        kept = np.where(wide, -1.0, np.where(near_wide | touching(t, ends), 0.0, np.nan))
        r, c = t.at(src)
        out = pd.DataFrame({"src": src, "dst": dst[r, c].astype(np.float64), "level": t.z[r, c], "steps": kept[r, c]})
        out.loc[wide[r, c], "dst"] = np.nan
        return out[columns]

    every = own.unionByName(source).unionByName(rim)
    found = every.groupBy("ty", "tx").applyInPandas(solve, "src long, dst double, level double, steps double")
    return found.select("src", F.nanvl("dst", F.lit(None).cast("double")).cast("long").alias("dst"), "level", F.nanvl("steps", F.lit(None).cast("double")).alias("steps"))


def wide_flats(parts: DataFrame, n_cols: int, side: int, limit: int = 10_000) -> DataFrame:
    """src, dst of flats that cross tiles. ``parts``: src, level, steps (0 for where a flat ends, -1 for its open cells).

    A round brings the steps of border cells to the next tiles; the rounds end when none changes.
    """

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        src, level, steps, open_ = (group[c].to_numpy() for c in ("src", "level", "steps", "open"))
        t = Tile(key, n_cols, side, src, level)
        count = np.full(t.z.shape, np.inf)
        t.put(count, src, np.where(steps < 0, np.inf, steps))
        inner = t.inner()
        free = np.zeros(t.z.shape, bool)
        t.put(free, src, open_)
        free &= inner
        count = spread(count, t.z, free)
        dst = along(t, np.full(t.z.shape, -1), free, count)
        r, c = t.at(src)
        mine = inner[r, c]
        found = np.where(np.isfinite(count), count, -1.0)
        return pd.DataFrame({"src": src, "level": level, "steps": found[r, c], "open": open_, "dst": dst[r, c]})[mine]

    state = cut(parts.select("src", "level", "steps", (F.col("steps") < 0).alias("open"), F.lit(-1).cast("long").alias("dst")), "flats")
    ty, tx = _key(F.col("src"), n_cols, side)
    ny, nx = _key(F.col("near"), n_cols, side)
    before = None
    for _ in range(limit):
        at_border = neighbours(state, n_cols).where(F.col("near").isNotNull() & _apart(F.col("src"), F.col("near"), n_cols, side))
        around = at_border.withColumn("ty", ny).withColumn("tx", nx).drop("near").distinct()
        both = state.withColumn("ty", ty).withColumn("tx", tx).unionByName(around)
        state = cut(both.groupBy("ty", "tx").applyInPandas(solve, "src long, level double, steps double, open boolean, dst long"), "flats")
        after = tuple(state.agg(F.bit_xor(F.xxhash64("src", "steps")), F.count("*")).first())
        if after == before:
            return state.where("open").select("src", "dst")
        before = after
    raise ValueError("the steps over flats did not settle")


def flow(dem: DataFrame, n_cols: int, px: tuple[float, float] = (1.0, 1.0), side: int = SIDE, value: str = "z") -> DataFrame:
    """src, dst, level: where each cell of an elevation grid (src, ``value``) drains, and its filled level.

    Cells without a value, null or NaN, are outside and have no row. A cell drains to its neighbour
    with the largest drop for each unit of distance (``px``: width and height of a cell), of equals
    the smaller number; cells of a flat along the fewest steps to its end; what leaves the grid
    drains to itself. No cycles. An empty grid gives no rows.
    """
    cells = dem.select(F.col("src").cast("long").alias("src"), F.col(value).cast("double").alias("z")).where(F.col("z").isNotNull() & ~F.isnan("z"))
    tiled = cut(regions(cells, n_cols, side), "regions")
    rim = tiled.where(F.col("kind") == _RIM).select("src", F.col("level").alias("z"))
    beyond = neighbours(rim, n_cols).where(_apart(F.col("src"), F.col("near"), n_cols, side)).join(rim.withColumnsRenamed({"src": "near", "z": "far"}).hint("merge"), "near", "left")
    met = beyond.where(F.col("far").isNull() | (F.col("src") > F.col("near")))
    across = met.select(F.col("src").alias("a"), F.when(F.col("far").isNotNull(), F.col("near")).otherwise(OUTSIDE).alias("b"), F.greatest("z", "far").alias("level")).distinct()
    links = tiled.where(F.col("kind") == _LINK).select(F.col("src").alias("a"), F.col("other").alias("b"), "level").unionByName(across)
    found = cut(drained(tiled, spill_levels(links), n_cols, side, px), "drained")
    open_ = found.where("steps is not null")
    if open_.where("steps < 0").isEmpty():
        return found.select("src", "dst", "level")
    wide = wide_flats(open_.select("src", "level", "steps"), n_cols, side).withColumnRenamed("dst", "along")
    return found.join(wide, "src", "left").select("src", F.coalesce("dst", "along").alias("dst"), "level")
