"""Sums over all rows of a table, computed in numpy blocks inside tasks and added up by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES


def summed(rows: DataFrame, length: int, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``function(block)`` over all blocks of feature rows.

    Every task adds its own blocks up first; only ``length`` numbers per task are shuffled and only
    ``length`` numbers come back.
    """

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length)
        for batch in batches:
            total += function(batch[FEATURES].to_numpy())
        yield pd.DataFrame({"i": np.arange(length), "x": total})

    added = rows.select(*FEATURES).mapInPandas(per_task, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(length)
    for i, x in added.collect():
        out[i] = x
    return out


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and mean and population standard deviation of every feature."""
    found = rows.agg(F.count(F.lit(1)), *[F.avg(f) for f in FEATURES], *[F.stddev_pop(f) for f in FEATURES]).first()
    d = len(FEATURES)
    return found[0], np.array(found[1:1 + d], dtype=float), np.array(found[1 + d:], dtype=float)
