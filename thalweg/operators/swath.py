"""Swath profiles: elevation statistics across a line, station by station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid, polylines


def statistics(samples: DataFrame, value: str = "z", quartiles: bool = False) -> DataFrame:
    """fid, station, n, mean, min, max, relief, hyps (and q1, q3): null where a station has no value."""
    v = F.col(value)
    low, high, mean = F.min(v), F.max(v), F.avg(v)
    flat = (high - low) > 1e-6
    out = [
        F.count(v).alias("n"), mean.alias("mean"), low.alias("min"), high.alias("max"), (high - low).alias("relief"),
        F.when(flat, (mean - low) / F.when(flat, high - low)).when(F.count(v) > 0, F.lit(0.5)).alias("hyps"),
    ]
    if quartiles:
        out += [F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.75)).alias("q3")]
    return samples.groupBy("fid", "station").agg(*out)


def profile(vertices: DataFrame, cells: DataFrame, meta: grid.GridMeta, n_stations: int = 200, half_width: float = 1000.0, n_transversal: int = 50, quartiles: bool = False, value: str = "z") -> DataFrame:
    """Statistics of ``n_transversal`` samples across each line at each of ``n_stations`` places."""
    across = polylines.transversals(polylines.stations(vertices, n_stations), half_width, n_transversal, meta.geographic)
    return statistics(grid.sample(across, cells, meta, value, "tx", "ty"), value, quartiles)


def nice_interval(value: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten, for ticks; 1 where the value is not positive."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.when(value > 0, value))))
    part = value / size
    nice = F.when(part < 1.5, 1.0).when(part < 3, 2.0).when(part < 7, 5.0).otherwise(10.0)
    return F.when(value > 0, nice * size).otherwise(F.lit(1.0))
