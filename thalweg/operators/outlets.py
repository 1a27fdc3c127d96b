"""Outlets of sub-basins: taken by accumulation, apart from each other, in blocks of the grid at once.

Whether a candidate is taken depends on the earlier ones near it only. A block decides the
candidates of its own whose earlier neighbours are all decided, in order; what hangs on another
block waits for the next round. The outcome is that of one pass over all candidates in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .flow import SPACING, confluences

#: Cells of a block's side. A candidate and its main stem lie within two cells of one junction.
BLOCK, REACH = 512, SPACING + 4
_OPEN, _TAKEN, _REFUSED = 0, 1, 2
_STATE = "src long, stem long, dst long, facc double, stem_facc double, state int, stem_taken boolean"


class _Nearby:
    """Points by squares, for the question whether one lies near."""

    def __init__(self, n_cols: int, reach: int):
        self.n_cols, self.reach, self.squares = n_cols, reach, {}

    def add(self, cell: int) -> None:
        r, c = divmod(cell, self.n_cols)
        self.squares.setdefault((r // self.reach, c // self.reach), []).append((r, c, cell))

    def any(self, cell: int, but: int | None = None) -> bool:
        r, c = divmod(cell, self.n_cols)
        y, x = r // self.reach, c // self.reach
        near = (p for i in (y - 1, y, y + 1) for j in (x - 1, x, x + 1) for p in self.squares.get((i, j), ()))
        return any(p[2] != but and abs(r - p[0]) < self.reach and abs(c - p[1]) < self.reach for p in near)


def greedy(candidates: DataFrame, fixed: DataFrame | None, n_cols: int, stems: bool, block: int = BLOCK, limit: int = 10_000) -> DataFrame:
    """The candidates taken (src, dst, facc, stem, stem_facc, stem_taken): in the order of falling facc, then src,
    each that keeps ``SPACING`` cells away on one axis from all taken before and from ``fixed`` (node).

    With ``stems`` a taken candidate's stem is taken next, unless it is too near to one taken before other than its candidate.
    """

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(key[0]), int(key[1])
        taken, waiting = _Nearby(n_cols, SPACING), _Nearby(n_cols, REACH)
        for node in group.loc[group["given"], "src"]:
            taken.add(int(node))
        out = []
        rows = group[~group["given"]].drop_duplicates("src").sort_values(["facc", "src"], ascending=[False, True])
        for src, stem, dst, facc, stem_facc, state, stem_taken in rows[[c.split()[0] for c in _STATE.split(", ")]].itertuples(index=False):
            src, stem = int(src), int(stem)
            own = src // n_cols // block == ty and src % n_cols // block == tx
            if state == _OPEN and own and taken.any(src):
                state = _REFUSED
            elif state == _OPEN and own and not waiting.any(src):
                state, stem_taken = _TAKEN, False
                taken.add(src)
                if stems and not taken.any(stem, but=src):
                    stem_taken = True
                    taken.add(stem)
            elif state == _TAKEN:
                taken.add(src)
                if stem_taken:
                    taken.add(stem)
            elif state == _OPEN:
                waiting.add(src)
            if own:
                out.append((src, stem, dst, facc, stem_facc, state, stem_taken))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])

    def around(cells: DataFrame) -> DataFrame:
        """Cells with each block (ty, tx) that they lie in or within reach of."""
        row, col = F.floor(F.col("src") / n_cols), F.col("src") % n_cols
        spans = (F.sequence(F.floor(F.greatest(v - 2 * REACH, F.lit(0)) / block), F.floor((v + 2 * REACH) / block)) for v in (row, col))
        ty, tx = spans
        return cells.withColumn("ty", F.explode(ty)).withColumn("tx", F.explode(tx))

    columns = [c.split()[0] for c in _STATE.split(", ")]
    start = candidates.withColumn("state", F.lit(_OPEN)).withColumn("stem_taken", F.lit(False)).select(columns)
    state = cut(start, "candidates")
    given = None
    if fixed is not None:
        blank = {"stem": F.lit(-1).cast("long"), "dst": F.lit(-1).cast("long"), "facc": F.lit(0.0), "stem_facc": F.lit(0.0), "state": F.lit(_TAKEN), "stem_taken": F.lit(False)}
        given = fixed.select(F.col("node").alias("src")).withColumns(blank).select(columns).withColumn("given", F.lit(True))
    for _ in range(limit):
        if state.where(F.col("state") == _OPEN).isEmpty():
            return state.where(F.col("state") == _TAKEN).drop("state")
        # Refused ones have no say any more.
        every = state.where(F.col("state") != _REFUSED).withColumn("given", F.lit(False))
        every = every if given is None else every.unionByName(given)
        state = cut(around(every).groupBy("ty", "tx").applyInPandas(solve, _STATE), "candidates")
    raise ValueError("the outlets did not settle")


def _taken(found: DataFrame, kinds: tuple[str, str], stage: int) -> DataFrame:
    """order (stage, -facc, src, part), node, dst, facc, kind: a row for each candidate and for each stem taken."""
    part = lambda k, node, facc, kind: F.struct(F.lit(k).alias("part"), F.col(node).alias("node"), F.col(facc).alias("facc"), F.lit(kind).alias("kind"))
    both = F.array_compact(F.array(part(0, "src", "facc", kinds[0]), F.when(F.col("stem_taken"), part(1, "stem", "stem_facc", kinds[1]))))
    each = found.select("src", "dst", F.col("facc").alias("first"), F.explode(both).alias("p"))
    return each.select(F.struct(F.lit(stage).alias("stage"), (-F.col("first")).alias("falling"), "src", "p.part").alias("order"), "p.node", "dst", "p.facc", "p.kind")


def _first(taken: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of taken outlets: a budget, given by the caller."""
    return taken.orderBy("order").limit(max(n, 0))


def lesser_inflows(flow: DataFrame, facc: DataFrame) -> DataFrame:
    """src, stem, dst, facc, stem_facc: the inflows of confluences but the main stem, which is the first in the order that ranks them: no second sort of the grid."""
    ranked = Window.partitionBy("dst").orderBy(F.desc("facc"), "src")
    stemmed = confluences(flow, facc).withColumns({"stem": F.first("src").over(ranked), "stem_facc": F.first("facc").over(ranked)})
    return stemmed.where("not main_stem").select("src", "stem", "dst", "facc", "stem_facc")


def outlets(flow: DataFrame, facc: DataFrame, n_cols: int, cell_m2: float, mode: str = "n", n_target: int = 25, least_m2: float = 10e6, main_stem: bool = True, edges: bool = True, block: int = BLOCK) -> DataFrame:
    """place, node, dst, area_m2, kind: outlets taken greedily by accumulation, ``SPACING`` cells apart.

    Sinks come first, a third of the budget at most; then the lesser inflows of confluences, each
    with its junction's main stem, which need not keep away from that one inflow. The budget of
    ``n_target`` - 1 ends the choice in mode ``n``, the threshold in mode ``area``, where the budget
    ends only the taking of main stems. Ties go to the smaller cell.
    """
    if mode not in ("n", "area"):
        raise ValueError(f"unknown mode {mode}")
    budget = max(1, n_target - 1)
    big = F.col("facc") * cell_m2 >= least_m2 if mode == "area" else F.lit(True)
    none = flow.sparkSession.createDataFrame([], "order struct<stage:int,falling:double,src:long,part:int>, node long, dst long, facc double, kind string")
    picked = none
    alone = lambda c: c.select("src", F.lit(-1).cast("long").alias("stem"), "dst", "facc", F.lit(0.0).alias("stem_facc"))
    if edges:
        sinks = flow.where("src = dst").join(facc, "src", "left").select("src", "dst", F.coalesce("facc", F.lit(0.0)).alias("facc")).where(big)
        picked = _taken(greedy(alone(sinks), None, n_cols, False, block), ("edge", ""), 0)
        picked = cut(_first(picked, max(1, budget // 3)) if mode == "n" else picked, "edges")
    left = budget - picked.count()
    lesser = cut(lesser_inflows(flow, facc).where(big), "lesser")
    if mode == "n" and left <= 0:
        inner = none
    else:
        inner = cut(_taken(greedy(lesser, picked, n_cols, main_stem and left > 0, block), ("internal", "main_stem"), 1), "inner")
        if mode == "n":
            inner = _first(inner, left)
        elif main_stem and 0 < left <= inner.count():
            # Stems end with the budget: what comes later is chosen anew without them.
            inner = cut(_first(inner, left), "inner")
            end = inner.agg(F.max("order").alias("o")).first()["o"]
            later = lesser.where(F.struct(-F.col("facc"), F.col("src")) > F.struct(F.lit(end["falling"]), F.lit(end["src"]).cast("long")))
            rest = greedy(later, picked.unionByName(inner).select("node"), n_cols, False, block)
            inner = inner.unionByName(_taken(rest, ("internal", "main_stem"), 2))
    every = picked.unionByName(inner)
    # A row for each outlet, far fewer than cells: numbered in order.
    place = F.row_number().over(Window.orderBy("order")) - 1
    return every.select(place.cast("long").alias("place"), "node", "dst", (F.col("facc") * cell_m2).alias("area_m2"), "kind")
