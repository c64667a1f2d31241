"""Reconstruction error of a small neural network trained to return its input."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.scalars import clip01
from ..schemas import FEATURES
from .alerts import HIT, graded, hit
from .detector import KEY, Detector
from .gradients import moments

_UNIT = float(1 << 34)  # averages are taken over whole numbers of this fraction
Layers = list[tuple[np.ndarray, np.ndarray]]


def unpack(flat: np.ndarray, sizes: list[int]) -> Layers:
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        layers.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return layers


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer: ReLU inside, linear at the end."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0.0) if i + 1 < len(layers) else z)
    return out


def gradient(flat: np.ndarray, sizes: list[int], x: np.ndarray) -> np.ndarray:
    """Sum over rows of the gradient of half the squared error, followed by the sum of errors."""
    layers = unpack(flat, sizes)
    acts = forward(layers, x)
    delta = acts[-1] - x
    parts, error = [], float((delta**2).sum())
    for i in reversed(range(len(layers))):
        parts = [(acts[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if i:
            delta = (delta @ layers[i][0].T) * (acts[i] > 0)
    return np.append(np.concatenate(parts), error)


class Autoencoder(Detector):
    """Local Adam steps and averaged weights: ``iterations`` passes over the rows, one job each.

    Rows are dealt to shards and ordered inside them by a hash of their key; the number of shards follows from the number of rows. In a
    pass every shard starts from the same weights and moments and takes steps over batches of its rows, several times over them if
    they are few, and the shards' results are averaged as whole numbers. So the model does not depend on partitions.
    """

    name = "mlp"

    def __init__(self, hidden: tuple[int, ...] = (16, 4, 16), percentile: float = 99.0, seed: int = 42,
                 iterations: int = 16, learning_rate: float = 0.01, l2: float = 1e-4, model_version: str = "v1",
                 batch: int = 128, shard_rows: int = 50_000, least_steps: int = 40) -> None:
        super().__init__(model_version)
        self.sizes = [len(FEATURES), *hidden, len(FEATURES)]
        self.percentile, self.seed = percentile, seed
        self.iterations, self.learning_rate, self.l2 = iterations, learning_rate, l2
        self.batch, self.shard_rows, self.least_steps = batch, shard_rows, least_steps

    def _start(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return np.concatenate(parts)

    def _pass(self, state: np.ndarray, steps: int, rate: float, n: int, mean: np.ndarray, scale: np.ndarray):
        """Train each shard of sorted rows; one row per shard: weights, both moments, steps taken and mean error, as whole numbers."""
        sizes, size, l2, least = self.sizes, self.batch, self.l2, self.least_steps
        count = len(state) // 3

        def train(shard: int, batches: Iterator[np.ndarray]) -> tuple:
            w, m, v = (part.copy() for part in state.reshape(3, -1))
            done, errors, rows, kept = 0, 0.0, 0, []

            def step(x: np.ndarray) -> float:
                nonlocal w, m, v, done
                total = gradient(w, sizes, x)
                g = total[:-1] / len(x) + l2 * w / n
                done += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - rate * (m / (1 - 0.9 ** (steps + done))) / (np.sqrt(v / (1 - 0.999 ** (steps + done))) + 1e-8)
                return total[-1]

            for x in batches:
                x = (x - mean) / scale
                errors, rows = errors + step(x), rows + len(x)
                if done <= least:
                    kept.append(x)
            while done < least:
                for x in kept:
                    step(x)
            return (shard, *[np.rint(p * _UNIT).astype(np.int64).tolist() for p in (w, m, v)], done, int(round(errors / rows / sizes[0] * _UNIT)))

        def blocks(shards: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
            """Batches of equal size, whatever the size of the pieces that rows come in."""
            for shard, parts in groupby(shards, key=lambda part: part[0]):
                def cut(parts=parts) -> Iterator[np.ndarray]:
                    held = np.zeros((0, len(FEATURES)))
                    for _, x in parts:
                        held = np.concatenate([held, x])
                        while len(held) >= 2 * size:
                            yield held[:size]
                            held = held[size:]
                    if len(held):
                        yield held
                yield shard, cut()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[tuple[int, np.ndarray]]:
                for batch in batches:
                    shard = batch.column("shard").to_numpy()
                    x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
                    edges = np.flatnonzero(np.diff(shard, prepend=-1))
                    for a, b in zip(edges, [*edges[1:], len(x)]):
                        yield int(shard[a]), x[a:b]

            for shard, parts in blocks(pieces()):
                found = train(shard, parts)
                yield pa.RecordBatch.from_pydict({
                    "i": np.arange(3 * count + 2), "x": np.concatenate([*found[1:4], [found[4] * int(_UNIT), found[5]]]).astype(np.int64)})

        return run

    def _fit(self, rows: DataFrame) -> None:
        n, mean, std = moments(rows)
        scale = np.where(std > 0, std, 1.0)
        shards = max(4, -(-n // self.shard_rows))
        dealt = rows.select(
            F.pmod(F.xxhash64(F.lit(self.seed), *KEY), F.lit(shards)).alias("shard"), F.xxhash64(F.lit(self.seed + 1), *KEY).alias("order"), *FEATURES)
        dealt = dealt.repartitionById(min(shards, 4096), F.pmod("shard", F.lit(min(shards, 4096))).cast("int"))
        dealt = dealt.sortWithinPartitions("shard", "order", *FEATURES).drop("order").persist()
        found = dealt.select("shard").distinct().count()
        start = self._start()
        state = np.concatenate([start, np.zeros(2 * len(start))])  # weights and both moments
        steps, best, quiet = 0, np.inf, 0
        for t in range(self.iterations):
            rate = self.learning_rate * (1 - 0.9 * t / self.iterations)
            total = dealt.mapInArrow(self._pass(state, steps, rate, n, mean, scale), "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
            out = np.zeros(3 * len(start) + 2)
            out[total.column("i").to_numpy()] = total.column("x").to_numpy() / found / _UNIT
            state, loss = out[:-2], out[-1]
            steps += int(out[-2])
            quiet = 0 if loss < best - 1e-4 else quiet + 1
            best = min(best, loss)
            if quiet > 3:
                break
        dealt.unpersist()
        self.model = {"weights": state[:len(start)].tolist(), "sizes": self.sizes, "mean": mean.tolist(), "scale": scale.tolist(), "threshold": 0.0}
        self.model["threshold"] = self._quantile(self._scored(rows), "mlp_error", self.percentile / 100)

    def _scored(self, profiles: DataFrame) -> DataFrame:
        layers = unpack(np.array(self.model["weights"]), self.model["sizes"])
        mean, scale = np.array(self.model["mean"]), np.array(self.model["scale"])

        @pandas_udf("double")
        def error(*columns: pd.Series) -> pd.Series:
            x = (np.column_stack([c.to_numpy(dtype=float) for c in columns]) - mean) / scale
            return pd.Series(((forward(layers, x)[-1] - x) ** 2).mean(axis=1))

        return profiles.withColumn("mlp_error", error(*[F.col(name).cast("double") for name in FEATURES]))

    def _hit(self) -> Column:
        threshold = float(self.model["threshold"])
        if threshold <= 0:  # no scale to measure a risk against
            return F.lit(None).cast(HIT)
        risk = clip01(F.col("mlp_error") / F.lit(threshold * 2))
        details = F.struct(F.round("mlp_error", 6).alias("recon_error"), F.round(F.lit(threshold), 6).alias("threshold"))
        found = hit("nn:mlp", "anomaly", graded(risk, 0.6), risk, details, self.model_version)
        return F.when(F.col("mlp_error") > threshold, found)
