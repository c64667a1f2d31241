"""One-class SVM with an RBF kernel, in random Fourier features (Rahimi, Recht 2007).

The dual asks for the point nearest the origin among all means of a ``nu`` share of the rows. It is
found by the Frank-Wolfe method: each step takes the mean of the ``nu`` share that scores lowest and
moves towards it by exact line search, until the gap to the optimum is below a share of the value. This approximates the kernel machine; the share of training
rows below the offset is ``nu``, as there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.scalars import feature_struct
from ..schemas import FEATURES
from .alerts import hit
from .detector import Detector
from .gradients import moments, summed
from .. import schemas


class OneClassSvm(Detector):
    name = "ocsvm"

    def __init__(self, nu: float = 0.02, n_features: int = 256, steps: int = 200, tolerance: float = 1e-3, seed: int = 42, model_version: str = "v1") -> None:
        super().__init__(model_version)
        self.nu, self.n_features, self.steps, self.tolerance, self.seed = nu, n_features, steps, tolerance, seed

    def _map(self, gamma: float):
        """x -> cosine features whose inner products approximate exp(-gamma * squared distance)."""
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(0.0, 1.0, (len(FEATURES), self.n_features)) * np.sqrt(2.0 * gamma)
        phases = rng.uniform(0.0, 2.0 * np.pi, self.n_features)
        scale = np.sqrt(2.0 / self.n_features)
        return lambda x: scale * np.cos(x @ directions + phases)

    def _fit(self, rows: DataFrame) -> None:
        n, mean, std = moments(rows)
        # gamma "scale": one over the number of features times the variance of all matrix entries
        variance = float(np.mean(std**2 + mean**2) - np.mean(mean) ** 2)
        self.model = {"gamma": 1.0 / (len(FEATURES) * variance) if variance > 0 else 1.0, "offset": 0.0}
        project = self._map(self.model["gamma"])
        w = summed(rows, self.n_features, lambda x: project(x).sum(axis=0)) / n
        for _ in range(self.steps):
            self.model["w"] = w.tolist()
            # a step needs the lowest share only roughly; the offset below is exact
            bound = self._with_scores(rows, 0.0).agg(F.percentile_approx("ocsvm_decision", self.nu, 10_000)).first()[0]

            def lowest(x: np.ndarray, w=w, bound=bound) -> np.ndarray:
                z = project(x)
                low = z[z @ w <= bound]
                return np.append(low.sum(axis=0), len(low))

            total = summed(rows, self.n_features + 1, lowest)
            vertex = total[:-1] / max(total[-1], 1.0)
            step = w - vertex
            length = float(step @ step)
            gap = float(w @ step)  # how far the optimum can be, at most
            self.model["gap"] = gap / max(float(w @ w), 1e-300)
            if length <= 0 or self.model["gap"] <= self.tolerance:
                break
            share = float(np.clip(gap / length, 0.0, 1.0))
            w = w - share * step
        self.model["w"] = w.tolist()
        self.model["offset"] = self._score_quantile(rows)

    def _score_quantile(self, rows: DataFrame) -> float:
        return self._quantile(self._with_scores(rows, 0.0), "ocsvm_decision", self.nu)

    def _with_scores(self, profiles: DataFrame, offset: float) -> DataFrame:
        project, w = self._map(self.model["gamma"]), np.array(self.model["w"])

        @pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(project(np.column_stack([c.to_numpy(dtype=float) for c in columns])) @ w)

        value = score(*[F.col(name).cast("double") for name in FEATURES])
        return profiles.withColumn("ocsvm_decision", value - F.lit(float(offset)))

    def _scored(self, profiles: DataFrame) -> DataFrame:
        return self._with_scores(profiles, self.model["offset"])

    def _hit(self) -> Column:
        details = F.struct(feature_struct().alias("features"))
        found = hit("ml:ocsvm", "anomaly", F.lit(schemas.MEDIUM), F.lit(0.7), details, self.model_version)
        return F.when(F.col("ocsvm_decision") < 0, found)
