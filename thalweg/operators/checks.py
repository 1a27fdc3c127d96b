"""Checks of inputs: what is not usable is told apart with a reason instead of failing a whole job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Columns that each tool's inputs must have.
INPUTS = {
    "rose": {"lines": ("fid", "vidx", "x", "y")},
    "swath": {"dem": ("row_i", "col_i", "z"), "lines": ("fid", "vidx", "x", "y")},
    "hypsometry": {"dem": ("row_i", "col_i", "z"), "basins": ("fid", "part", "ring", "vidx", "x", "y")},
    "channel": {"dem": ("row_i", "col_i", "z"), "basins": ("fid", "part", "ring", "vidx", "x", "y"), "streams": ("fid", "vidx", "x", "y")},
    "fluvial": {"dem": ("row_i", "col_i", "z"), "basins": ("fid", "part", "ring", "vidx", "x", "y"), "streams": ("fid", "vidx", "x", "y")},
    "watershed": {"directions": ("src", "row_i", "col_i", "fdir"), "accumulation": ("src", "facc")},
    "digitizer": {"pixels": ("row_i", "col_i", "r", "g", "b")},
}


def problems(tool: str, **inputs: DataFrame | None) -> list[str]:
    """What keeps a tool from running: inputs that are missing, lack a column or have no row."""
    if tool not in INPUTS:
        raise ValueError(f"unknown tool {tool!r}; known: {', '.join(sorted(INPUTS))}")
    found = []
    for name, columns in INPUTS[tool].items():
        df = inputs.get(name)
        if df is None:
            found.append(f"{name}: missing")
        elif lacking := [c for c in columns if c not in df.columns]:
            found.append(f"{name}: no column {', '.join(lacking)}")
        elif df.isEmpty():
            found.append(f"{name}: no row")
    return found


def ring_faults(rings: DataFrame) -> DataFrame:
    """fid and reason of polygons with a ring under four points, open, or without area."""
    w = Window.partitionBy("fid", "part", "ring").orderBy("vidx")
    cross = F.col("x") * F.lead("y").over(w) - F.lead("x").over(w) * F.col("y")
    each = rings.withColumn("c", cross).groupBy("fid", "part", "ring").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("x", "y"), "vidx").alias("a"),
        F.max_by(F.struct("x", "y"), "vidx").alias("b"),
        F.abs(F.sum("c") / 2).alias("area"),
    )
    reason = (
        F.when(F.col("n") < 4, F.lit("ring of fewer than four points")).when(F.col("a") != F.col("b"), F.lit("open ring")).when(F.coalesce("area", F.lit(0.0)) == 0, F.lit("ring without area"))
    )
    return each.select("fid", reason.alias("reason")).where("reason is not null").groupBy("fid").agg(F.min("reason").alias("reason"))


def closed(vertices: DataFrame) -> DataFrame:
    """Lines (fid, vidx, x, y) with their first vertex again at the end where it differs from the last."""
    ends = vertices.groupBy("fid").agg(F.min_by(F.struct("x", "y"), "vidx").alias("a"), F.max_by(F.struct("x", "y"), "vidx").alias("b"), F.max("vidx").alias("last"))
    more = ends.where(F.col("a") != F.col("b")).select("fid", (F.col("last") + 1).cast("long").alias("vidx"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    return vertices.select("fid", F.col("vidx").cast("long").alias("vidx"), "x", "y").unionByName(more)


def usable(rings: DataFrame, cell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(polygons without faults, fid and reason of the others). Open rings are closed first.

    With ``cell``, the size of the squares in which edges meet, rings that cross or overlap are repaired.
    """
    key = ["fid", "part", "ring"]
    named = rings.withColumn("id_", F.struct(*key))
    shut = closed(named.select(F.col("id_").alias("fid"), "vidx", "x", "y")).select("fid.*", "vidx", "x", "y")
    if cell is not None:
        from .repair import repaired

        shut = cut(repaired(shut, cell)[0], "sound")
    faults = cut(ring_faults(shut), "faults")
    return shut.join(faults.select("fid").hint("merge"), "fid", "left_anti"), faults


def first_feature(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the smallest fid, a warning row if there are more features)."""
    low = features.agg(F.min("fid").alias("fid"), F.countDistinct("fid").alias("n"))
    first = features.join(low.select("fid"), "fid", "left_semi")
    return first, low.where("n > 1").select("fid", F.format_string("only the first of %d features is used", "n").alias("message"))


def of_type(features: DataFrame, kind: str) -> DataFrame:
    """Features (fid, vidx, …) that have the shape of a ``point`` (one vertex), ``line`` (two or more, open) or ``polygon`` (a closed ring of four or more)."""
    shape = features.groupBy("fid").agg(F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "vidx").alias("a"), F.max_by(F.struct("x", "y"), "vidx").alias("b"))
    kinds = {"point": F.col("n") == 1, "line": (F.col("n") >= 2) & ~((F.col("n") >= 4) & (F.col("a") == F.col("b"))), "polygon": (F.col("n") >= 4) & (F.col("a") == F.col("b"))}
    return features.join(shape.where(kinds[kind]).select("fid"), "fid", "left_semi")
