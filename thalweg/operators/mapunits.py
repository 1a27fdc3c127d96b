"""Colour map units: k-means of pixels, median filter, sieve and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Pixels up to which the first centres are drawn by shuffling all numbers.
MOST_SHUFFLED = 10_000_000


def rgb(bands: DataFrame, n_bands: int) -> DataFrame:
    """row_i, col_i, r, g, b from one to three bands: one is grey, of two the blue is 0."""
    g = F.col("b1") if n_bands == 1 else F.col("b2")
    b = F.col("b1") if n_bands == 1 else F.lit(0) if n_bands == 2 else F.col("b3")
    return bands.select("row_i", "col_i", F.col("b1").alias("r"), g.alias("g"), b.cast("long").alias("b"))


def decoded(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """row_i, col_i, r, g, b of a palette image (index); an index without a colour is black."""
    return pixels.join(palette, "index", "left").select("row_i", "col_i", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in "rgb"])


def assigned(pixels: DataFrame, centres: list[tuple[float, float, float]]) -> DataFrame:
    """Pixels with ``cluster``, the nearest centre, the first of equals. The centres are an expression: nothing is joined."""
    d = [F.struct(sum(((F.col(c).cast("double") - v) * (F.col(c).cast("double") - v) for c, v in zip("rgb", centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("cluster")) for i, centre in enumerate(centres)]
    return pixels.withColumn("cluster", F.least(*d)["cluster"] if len(d) > 1 else F.lit(0))


def moved(pixels: DataFrame, centres: list[tuple[float, float, float]]) -> DataFrame:
    """cluster, r, g, b, n: the mean of each cluster that has pixels."""
    return assigned(pixels, centres).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in "rgb"], F.count("*").alias("n"))


def kmeans(pixels: DataFrame, k: int, n_cols: int, rounds: int = 50, tolerance: float = 1.0, seed: int = 42) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(pixels with ``cluster``, final centres cut to whole numbers).

    The first centres, and those of clusters left empty, are pixels drawn by number in row order
    with a seeded generator. Ends when no centre moves by ``tolerance``; the labels are those before
    the last move. The driver holds k centres.
    """
    import numpy as np

    pixels = cut(pixels.select("row_i", "col_i", "r", "g", "b"), "pixels")
    rows = pixels.groupBy("row_i").agg(F.count("*").alias("n")).orderBy("row_i").collect()  # an image's height bounds them
    ends = np.cumsum([r["n"] for r in rows])
    n = int(ends[-1]) if rows else 0
    rng = np.random.RandomState(seed)

    def colours(at: list[int]) -> list[tuple[float, float, float]]:
        """Of the pixels with these numbers: pixels there are count in row order, gaps do not."""
        where = [(rows[k]["row_i"], i - int(ends[k]) + rows[k]["n"]) for i in at for k in [int(np.searchsorted(ends, i, side="right"))]]
        place = F.row_number().over(Window.partitionBy("row_i").orderBy("col_i")) - 1
        mine = pixels.where(F.col("row_i").isin([r for r, _ in where])).withColumn("place", place)
        wanted = F.concat_ws(",", "row_i", "place").isin([f"{r},{p}" for r, p in where])
        got = {(r["row_i"], r["place"]): (float(r["r"]), float(r["g"]), float(r["b"])) for r in mine.where(wanted).collect()}
        return [got[w] for w in where]

    if n <= MOST_SHUFFLED:
        first = rng.choice(n, min(k, n), replace=False).tolist() if n else []
    else:  # a permutation of all pixels would not fit the driver; numbers are drawn until k differ
        drawn: dict[int, None] = {}
        while len(drawn) < k:
            drawn[int(rng.randint(0, n))] = None
        first = list(drawn)
    centres = colours(first) if n else []
    used = centres
    for _ in range(rounds if n else 0):
        means = {r["cluster"]: (r["r"], r["g"], r["b"]) for r in moved(pixels, centres).collect()}
        empty = [i for i in range(len(centres)) if i not in means]
        means |= dict(zip(empty, colours([int(rng.randint(0, n)) for _ in empty]) if empty else []))
        new = [means[i] for i in range(len(centres))]
        shift = max(sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5 for x, y in zip(new, centres))
        used, centres = centres, new
        if shift < tolerance:
            break
    labels = assigned(pixels, used) if used else pixels.withColumn("cluster", F.lit(0))
    return labels, [tuple(int(v) for v in c) for c in centres]


def hex_colour(r, g, b):
    """#rrggbb."""
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in (r, g, b)])


#: Cells of a side of the squares in which medians are taken.
MEDIAN_SIDE = 512


def median(labels: DataFrame, n_rows: int, n_cols: int, size: int = 5, column: str = "cluster", side: int = MEDIAN_SIDE) -> DataFrame:
    """row_i, col_i, ``column``: the middle of the size x size values around each cell; edges are mirrored.

    The grid is cut into squares; cells near a square's sides go to those beside it too, so the grid
    is shuffled once and little more. Under size 3 nothing changes; even sizes grow by one. Cells that
    are not there are no values, and get none.
    """
    import numpy as np
    import pandas as pd

    if size < 3:
        return labels.select("row_i", "col_i", column)
    half = size // 2
    width = 2 * half + 1
    side = max(side, width)
    kind = labels.schema[column].dataType.simpleString()

    def tiles(c: str, n: int):
        last = (n - 1) // side
        at = F.col(c)
        return F.sequence(F.greatest(F.floor((at - half) / side), F.lit(0)), F.least(F.floor((at + half) / side), F.lit(last)))

    def middle(group: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(group["ty"].iat[0]) * side, int(group["tx"].iat[0]) * side
        r1, c1 = min(r0 + side, n_rows), min(c0 + side, n_cols)
        # The square and its surroundings; places that are not there sort last.
        known = np.full((r1 - r0 + 2 * half, c1 - c0 + 2 * half), np.inf)
        r, c = group["row_i"].to_numpy(np.int64), group["col_i"].to_numpy(np.int64)
        known[r - r0 + half, c - c0 + half] = group["v"].to_numpy(np.float64)

        def mirrored(first: int, end: int, n: int) -> np.ndarray:
            at = np.arange(first - half, end + half)
            at = np.where(at < 0, -1 - at, np.where(at >= n, 2 * n - 1 - at, at))
            return np.clip(at, 0, n - 1) - first + half

        known = known[np.ix_(mirrored(r0, r1, n_rows), mirrored(c0, c1, n_cols))]
        rows, cols, values = [], [], []
        for i in range(r1 - r0):
            around = np.lib.stride_tricks.sliding_window_view(known[i : i + width], (width, width))[0].reshape(c1 - c0, -1)
            have = np.isfinite(around).sum(axis=1)
            here = np.flatnonzero(np.isfinite(known[i + half, half : half + c1 - c0]))
            rows.append(np.full(len(here), r0 + i))
            cols.append(c0 + here)
            values.append(np.sort(around[here], axis=1)[np.arange(len(here)), have[here] // 2])
        return pd.DataFrame({"row_i": np.concatenate(rows), "col_i": np.concatenate(cols), column: np.concatenate(values)})

    dealt = labels.select("row_i", "col_i", F.col(column).cast("double").alias("v"), F.explode(tiles("row_i", n_rows)).alias("ty")).withColumn("tx", F.explode(tiles("col_i", n_cols)))
    found = dealt.groupBy("ty", "tx").applyInPandas(middle, f"row_i long, col_i long, {column} double")
    return found.withColumn(column, F.col(column).cast(kind))
