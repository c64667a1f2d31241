"""Isolation forest (Liu, Ting, Zhou 2008): trees are grown in parallel from small samples."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.scalars import clip01, feature_struct
from ..schemas import FEATURES
from .alerts import graded, hit
from .detector import KEY, Detector

SAMPLE = 256
SPARE = 1.5  # candidates drawn per tree for each row that is kept
NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth) of a random tree; leaves have feature -1."""
    limit = ceil(log2(max(len(x), 2)))
    nodes: list[tuple] = [()]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (-1, 0.0, at, at, depth + float(average_path(len(rows))))
            continue
        f = int(rng.choice(usable))
        threshold = float(rng.uniform(low[f], high[f]))
        goes_left = x[rows, f] <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[at] = (f, threshold, left, right, 0.0)
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


class IsoForest(Detector):
    name = "isoforest"

    def __init__(self, n_trees: int = 200, contamination: float = 0.02, seed: int = 42, model_version: str = "v1") -> None:
        super().__init__(model_version)
        self.n_trees, self.contamination, self.seed = n_trees, contamination, seed

    def _samples(self, rows: DataFrame, n: int) -> DataFrame:
        """About ``SAMPLE * SPARE`` rows for each tree, chosen by a hash of tree and profile key; only hits are exploded."""
        share = SAMPLE * SPARE / n
        trees = F.filter(
            F.sequence(F.lit(0), F.lit(self.n_trees - 1)),
            lambda tree: F.abs(F.xxhash64(F.lit(self.seed), tree, *KEY) / float(2**63)) <= share)
        return rows.withColumn("tree", F.explode(trees))

    def _fit(self, rows: DataFrame) -> None:
        n, seed = rows.count(), self.seed
        order = F.xxhash64(F.lit(seed + 2), "tree", *KEY).alias("order")

        def build(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
            x = sample.sort_values("order").head(SAMPLE)[FEATURES].to_numpy()
            nodes = grow(x, np.random.default_rng([seed, key[0]]))
            out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
            return out.assign(tree=key[0], node=range(len(nodes)))[[c.split()[0] for c in NODES.split(", ")]]

        # at most n_trees * (2 * SAMPLE - 1) nodes, whatever the size of the training table
        grown = self._samples(rows, n).select("tree", order, *FEATURES).groupBy("tree").applyInPandas(build, NODES)
        nodes = grown.toPandas().sort_values(["tree", "node"])
        model = {c: nodes[c].tolist() for c in ("feature", "threshold", "left", "right", "depth")}
        model["roots"] = np.flatnonzero(nodes["node"].to_numpy() == 0).tolist()
        model["sample"] = min(SAMPLE, n)
        self.model = {**model, "offset": 0.0}
        self.model["offset"] = self._quantile(self._with_scores(rows), "isoforest_decision", self.contamination)

    def _with_scores(self, profiles: DataFrame) -> DataFrame:
        m = self.model
        shift = np.repeat(m["roots"], np.diff([*m["roots"], len(m["feature"])]))
        forest = profiles.sparkSession.sparkContext.broadcast((
            np.array(m["feature"]), np.array(m["threshold"]), np.array(m["left"]) + shift,
            np.array(m["right"]) + shift, np.array(m["depth"]), np.array(m["roots"])))
        scale = float(average_path(m["sample"])) or 1.0

        @pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            feature, threshold, left, right, depth, roots = forest.value
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            out = np.empty(len(x))
            for start in range(0, len(x), 2000):
                part = x[start:start + 2000]
                at = np.tile(roots, (len(part), 1))
                rows = np.arange(len(part))[:, None]
                for _ in range(ceil(log2(SAMPLE)) + 1):
                    f = feature[at]
                    lower = part[rows, np.maximum(f, 0)] <= threshold[at]
                    at = np.where(f < 0, at, np.where(lower, left[at], right[at]))
                out[start:start + 2000] = -np.power(2.0, -depth[at].mean(axis=1) / scale)
            return pd.Series(out)

        value = score(*[F.col(name).cast("double") for name in FEATURES])
        return profiles.withColumn("isoforest_decision", value - F.lit(float(m["offset"])))

    def _scored(self, profiles: DataFrame) -> DataFrame:
        return self._with_scores(profiles)

    def _hit(self) -> Column:
        risk = clip01(0.5 - F.col("isoforest_decision"))
        details = F.struct(F.round("isoforest_decision", 4).alias("decision_function"), feature_struct().alias("features"))
        found = hit("ml:isoforest", "anomaly", graded(risk, 0.6, 0.8), risk, details, self.model_version)
        return F.when(F.col("isoforest_decision") < 0, found)
