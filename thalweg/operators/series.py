"""Operations along a profile (basin_id, idx): smoothing, filling, slopes, orientation and integrals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(key: str = "basin_id", order: str = "idx") -> Window:
    return Window.partitionBy(key).orderBy(order)


def whole(key: str = "basin_id") -> Window:
    return Window.partitionBy(key)


def trapezoid(y: Column, x: Column, w: Window) -> Column:
    """The step of a trapezoid integral that ends at a row; null at the first."""
    return (y + F.lag(y).over(w)) / 2 * (x - F.lag(x).over(w))


def slope(profile: DataFrame, z: str = "elev", d: str = "dist_m", least: float = 1e-8, order: str = "idx") -> DataFrame:
    """``slope``: centred difference over distance, one-sided at the ends, never below ``least``."""
    w = along(order=order)
    near = lambda c, f: F.coalesce(f(c).over(w), F.col(c))
    dz, dd = near(z, F.lead) - near(z, F.lag), near(d, F.lead) - near(d, F.lag)
    return profile.withColumn("slope", F.when(dd > 1e-6, F.greatest(F.abs(dz) / F.when(dd > 1e-6, dd), F.lit(least))).otherwise(F.lit(least)))


def filled(profile: DataFrame, column: str, out: str, least: float | None = None) -> DataFrame:
    """Null values take the last value before them, else the first after; values not above 0 become ``least``."""
    w = along()
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    v = F.coalesce(before, after)
    return profile.withColumn(out, v if least is None else F.when(v <= 0, F.lit(least)).otherwise(v))


def high_to_low(profile: DataFrame, z: str = "elev", d: str = "dist_m") -> DataFrame:
    """Profiles whose first known elevation is under the last are turned: idx and distance are mirrored."""
    w = along()
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(z, ignorenulls=True).over(full), F.last(z, ignorenulls=True).over(full)
    n, end = F.count("*").over(whole()), F.last(d).over(full)
    turned = profile.withColumn("turn", F.coalesce(first < last, F.lit(False))).withColumn("n_", n).withColumn("end_", end)
    return (
        turned.withColumn("idx", F.when(F.col("turn"), F.col("n_") - 1 - F.col("idx")).otherwise(F.col("idx")))
        .withColumn(d, F.when(F.col("turn"), F.round(F.col("end_") - F.col(d), 2)).otherwise(F.col(d)))
        .drop("n_", "end_")
    )


def savgol_weights(window: int) -> list[float]:
    """Weights of a quadratic least-squares fit at the window's centre."""
    m = window // 2
    denominator = (2 * m - 1) * (2 * m + 1) * (2 * m + 3)
    return [3 * (3 * m * m + 3 * m - 1 - 5 * j * j) / denominator for j in range(-m, m + 1)]


def hanning_weights(window: int) -> list[float]:
    raw = [0.5 - 0.5 * math.cos(2 * math.pi * j / (window - 1)) for j in range(window)]
    return [w / sum(raw) for w in raw]


def smoothed(profile: DataFrame, column: str, window: int, kind: str = "savgol", out: str = "smooth", key: str = "basin_id", order: str = "idx") -> DataFrame:
    """``out``: a weighted sum over ``window`` rows, the end values repeated beyond the ends.

    A window as long as a profile or longer shrinks to half of it; even windows lose one; under
    three rows nothing is smoothed. A null within the window gives null.
    """
    w = along(key, order)
    sized = profile.withColumn("n_", F.count("*").over(Window.partitionBy(key)))
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = sized.withColumn("first_", F.first(column).over(full)).withColumn("last_", F.last(column).over(full))
    pos = F.row_number().over(w)
    sized = sized.withColumn("pos_", pos)
    own = F.when(F.col("n_") <= window, F.floor(F.col("n_") / 2)).otherwise(F.lit(window))
    own = F.when(own % 2 == 0, own - 1).otherwise(own).cast("int")
    sized = sized.withColumn("win_", F.when(F.col("n_") < 3, F.lit(1)).otherwise(own))
    top = window if window % 2 else window - 1

    def tap(j: int) -> Column:
        if j == 0:
            return F.col(column)
        near = (F.lead(column, j) if j > 0 else F.lag(column, -j)).over(w)
        inside = (F.col("pos_") + j >= 1) & (F.col("pos_") + j <= F.col("n_"))
        return F.when(inside, near).otherwise(F.col("last_" if j > 0 else "first_"))

    taps = [tap(j) for j in range(-(top // 2), top // 2 + 1)]
    sized = sized.select("*", *[t.alias(f"t{k}_") for k, t in enumerate(taps)])
    value = F.col(column)
    for size in range(3, top + 1, 2):
        weights = savgol_weights(size) if kind == "savgol" else hanning_weights(size)
        low = top // 2 - size // 2
        total = sum((F.col(f"t{low + k}_") * F.lit(x) for k, x in enumerate(weights)), F.lit(0.0))
        value = F.when(F.col("win_") == size, total).otherwise(value)
    return sized.withColumn(out, value).drop("n_", "first_", "last_", "pos_", "win_", *[f"t{k}_" for k in range(len(taps))])
