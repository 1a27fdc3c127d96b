"""Connected components and cycles of graphs that are far smaller than the grids they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


def roots(hops: DataFrame, limit: int = 64) -> DataFrame:
    """node, root: where following ``root`` from each node ends, by doubling; roots point to themselves or have no row."""
    state = cut(hops.select("node", "root"), "hops")
    before = None
    for _ in range(limit):
        at = state.select(F.col("node").alias("root"), F.col("root").alias("further"))
        state = cut(state.join(at, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "hops")
        now = tuple(state.agg(F.bit_xor(F.xxhash64("node", "root")), F.count("*")).first())
        if now == before:
            return state
        before = now
    raise ValueError("the hops have cycles")


def components(edges: DataFrame, limit: int = 64) -> DataFrame:
    """node, root: the smallest node of each component of undirected ``edges`` (a, b); nodes without an edge have no row.

    Each round every node that has a smaller neighbour hooks to its smallest one, and all edges move
    to where the hooks end.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    found = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "components")
    for _ in range(limit):
        # The larger end of every edge has a smaller neighbour.
        hooks = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        if pairs.isEmpty():
            return found
        ends = roots(hooks)
        to = ends.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = cut(found.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "components")
        moved = pairs.join(to.withColumnsRenamed({"root": "a", "top": "ta"}), "a", "left").join(to.withColumnsRenamed({"root": "b", "top": "tb"}), "b", "left")
        moved = moved.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b")
        pairs = cut(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    raise RuntimeError(f"components did not settle in {limit} rounds")


def cycle_minima(nodes: DataFrame, limit: int = 64) -> DataFrame:
    """node, least: the smallest ``value`` on the cycle of each node (node, ptr, value); every node is on a cycle.

    Each round a node looks at twice as many that follow it. When a round changes nothing, all have seen their cycle's smallest.
    """
    state = cut(nodes.select("node", "ptr", F.col("value").alias("least")), "cycles")
    before = None
    for _ in range(limit):
        at = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("further"), F.col("least").alias("seen"))
        state = cut(state.join(at, "ptr").select("node", F.col("further").alias("ptr"), F.least("least", "seen").alias("least")), "cycles")
        now = tuple(state.agg(F.bit_xor(F.xxhash64("node", "least")), F.count("*")).first())
        if now == before:
            return state.select("node", "least")
        before = now
    raise RuntimeError("the cycles did not settle")


def cycle_places(nodes: DataFrame) -> DataFrame:
    """node, cycle, place: the smallest node of each node's cycle (node, ptr), and the steps from it; every node is on a cycle."""
    from .flow import gathered

    least = cycle_minima(nodes.withColumn("value", F.col("node")))
    opened = nodes.join(least, "node").select("node", F.when(F.col("ptr") != F.col("least"), F.col("ptr")).alias("ptr"), F.lit(1).cast("long").alias("acc"))
    return least.join(gathered(opened), "node").select("node", F.col("least").alias("cycle"), (F.col("acc") - 1).alias("place"))
