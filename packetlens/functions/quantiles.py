"""Exact order statistics of a distributed column."""

from __future__ import annotations

from math import floor, inf, nextafter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_ERROR = 1e-4  # percentile_approx with accuracy 10,000


def exact_quantile(df: DataFrame, column: str, q: float, limit: int = 10_000) -> float | None:
    """The ``q`` quantile with linear interpolation, or None for an empty column.

    Sketches only narrow the range that holds a wanted rank; the answer is read from exact counts. At most
    ``limit`` values reach the driver, whatever the size of ``df``.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    total = values.count()
    if total == 0:
        return None
    rank = (total - 1) * q
    low = floor(rank)
    first = _order_statistic(values, total, low, limit)
    second = first if rank == low else _order_statistic(values, total, low + 1, limit)
    return first + (second - first) * (rank - low)


def _order_statistic(values: DataFrame, total: int, rank: int, limit: int) -> float:
    """The value of a 0-based rank among ``total`` rows: the range around it is narrowed until few rows are left.

    A range of one value is the answer itself, however many rows share it; one that a sketch cannot narrow is halved.
    """
    margin = 2 * RANK_ERROR
    while total > limit:
        spread = [max(rank / total - margin, 0.0), min((rank + 1) / total + margin, 1.0)]
        sketch = values.agg(F.percentile_approx("v", spread, 10_000), F.min("v"), F.max("v")).first()
        (lo, hi), least, most = sketch[0], sketch[1], sketch[2]
        if least == most:
            return least
        if lo <= least and hi >= most:  # nothing gained: halve
            middle = least + (most - least) / 2
            lo, hi = (least, middle) if values.where(F.col("v") <= middle).count() > rank else (nextafter(middle, inf), most)
        below, inside = values.select(
            F.count_if(F.col("v") < lo), F.count_if((F.col("v") >= lo) & (F.col("v") <= hi))).first()
        if not below <= rank < below + inside:
            margin *= 4  # the sketch missed the rank: look at a wider range
            continue
        if lo == hi:
            return lo
        values = values.where((F.col("v") >= lo) & (F.col("v") <= hi))
        total, rank = inside, rank - below
    return sorted(r[0] for r in values.collect())[rank]
