"""Distance to the nearest of a few cluster centres."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip01
from ..schemas import FEATURES
from .alerts import HIT, graded, hit
from .detector import KEY, Detector


SAMPLE = 4096  # rows that starting centres are drawn from
STEPS = 300
TOLERANCE = 1e-4  # of the mean variance: centres that move less are settled


def squared(centre: list[float]) -> Column:
    """Squared distance of a profile to a centre."""
    terms = [(F.col(f).cast("double") - F.lit(c)) * (F.col(f).cast("double") - F.lit(c)) for f, c in zip(FEATURES, centre)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def starting_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: rows drawn by their squared distance to the centres so far; fewer if rows run out."""
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    while len(chosen) < k:
        away = np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        if away.sum() <= 0:
            break
        chosen.append(x[rng.choice(len(x), p=away / away.sum())])
    return np.array(chosen)


class KMeansDistance(Detector):
    name = "kmeans"

    def __init__(self, k: int = 8, percentile: float = 99.0, seed: int = 42, model_version: str = "v1") -> None:
        super().__init__(model_version)
        self.k, self.percentile, self.seed = k, percentile, seed

    def _fit(self, rows: DataFrame) -> None:
        # k-means++ over the rows with the smallest key hashes, then Lloyd steps over all rows
        order = F.xxhash64(F.lit(self.seed), *KEY)
        sample = rows.select(order.alias("order"), *KEY, *FEATURES).orderBy("order", *KEY).limit(SAMPLE)
        centres = starting_centres(np.array([r[1 + len(KEY):] for r in sample.collect()], dtype=float), self.k, self.seed)
        spread = rows.agg(*[F.var_pop(f) for f in FEATURES]).first()
        enough = TOLERANCE * float(np.mean([v or 0.0 for v in spread]))
        for _ in range(STEPS):
            moved = self._step(rows, centres)
            shift = float(((moved - centres) ** 2).sum())
            centres = moved
            if shift <= enough:
                break
        self.with_centres(rows, centres.tolist())

    def _step(self, rows: DataFrame, centres: np.ndarray) -> np.ndarray:
        """Means of the rows nearest to each centre; sums are decimal, so their order cannot change them."""
        away = F.array(*[F.struct(squared(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres.tolist())])
        near = rows.withColumn("near", F.array_min(away)["i"])
        sums = near.groupBy("near").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("decimal(28,6)")).alias(f) for f in FEATURES])
        out = centres.copy()  # a centre without rows stays
        for r in sums.collect():
            out[r["near"]] = [float(r[f]) / r["n"] for f in FEATURES]
        return out

    def with_centres(self, rows: DataFrame, centres: list[list[float]]) -> KMeansDistance:
        """Use given centres; the threshold is the percentile of the distances of ``rows``."""
        self.model = {"centres": centres, "threshold": 0.0}
        self.model["threshold"] = self._quantile(self._scored(rows), "kmeans_distance", self.percentile / 100)
        return self

    def _scored(self, profiles: DataFrame) -> DataFrame:
        # one row per (profile, centre) would multiply the data; the few centres are literals instead
        nearest = F.array_min(F.array(*[squared(c) for c in self.model["centres"]]))
        return profiles.withColumn("kmeans_distance", F.sqrt(nearest))

    def _hit(self) -> Column:
        threshold = float(self.model["threshold"])
        if threshold <= 0:  # no scale to measure a risk against
            return F.lit(None).cast(HIT)
        risk = clip01(F.col("kmeans_distance") / F.lit(threshold * 2))
        details = F.struct(F.round("kmeans_distance", 4).alias("distance"), F.round(F.lit(threshold), 4).alias("threshold"))
        found = hit("ml:kmeans", "anomaly", graded(risk, 0.6), risk, details, self.model_version)
        return F.when(F.col("kmeans_distance") > threshold, found)
