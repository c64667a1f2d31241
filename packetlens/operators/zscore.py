"""Deviation of a host from its own exponentially weighted profile.

One profile moves the mean m and variance v of a metric to m + α d and (1 - α)(v + α d²) with d = x - m. A run of k
profiles is an affine map of the mean and the second moment: with a = (1 - α)^k it mixes the state before, with weight
a, and the run's own weighted mean and variance, with weight 1 - a. Such maps compose, so a host's history is scanned in
parallel: every (host, stretch of time) is folded to one row, a scan over these few rows gives each stretch the state it
starts from, and all stretches are scored at the same time. No task needs more of a host than one stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import window_type_code
from .alerts import alerts_of, graded, hit

METRICS = ["pps", "bps", "uniq_dst_ip", "uniq_dst_port"]
KEY = ["host_id", "window_start", "window_end", "window_type"]
SCORED = "host_id string, window_start timestamp, window_end timestamp, window_type string, " + ", ".join(
    f"z_{m} double" for m in METRICS)
STRETCH_SEC = 86_400  # of window ends that are folded one after another

_PARTS = ["mean", "var", "own_mean", "own_var"]
_FOLDS = "host_id string, stretch long, k long, " + ", ".join(f"{p} array<double>" for p in _PARTS)


def advance(state: list[float] | None, values: list[float], alpha: float) -> tuple[list[float], list[float]]:
    """Score ``values`` against ``state`` = [mean, variance] per metric, then update it."""
    if state is None:
        return [part for x in values for part in (x, 0.0)], [0.0] * len(values)
    after, scores = [], []
    for i, x in enumerate(values):
        mean, var = state[2 * i], state[2 * i + 1]
        diff, std = x - mean, var ** 0.5
        scores.append(diff / std if std > 1e-9 else 0.0)
        after += [mean + alpha * diff, (1 - alpha) * (var + alpha * diff * diff)]
    return after, scores


def stepped(mean: np.ndarray, var: np.ndarray, x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many runs at once: scores and the states after them; a mean that is not a number has seen nothing yet."""
    fresh = np.isnan(mean)
    diff, std = np.where(fresh, 0.0, x - mean), np.sqrt(var)
    z = np.divide(diff, std, out=np.zeros_like(diff), where=std > 1e-9)
    return z, np.where(fresh, x, mean + alpha * diff), np.where(fresh, 0.0, (1 - alpha) * (var + alpha * diff * diff))


def mixed(mean: np.ndarray, var: np.ndarray, own_mean: np.ndarray, own_var: np.ndarray, a: float) -> tuple[np.ndarray, np.ndarray]:
    """The state after a run with own mean and variance, of which the state before keeps the weight ``a``."""
    apart = own_mean - mean
    return mean + (1 - a) * apart, a * var + (1 - a) * own_var + a * (1 - a) * apart * apart


class Runs:
    """The (host, stretch) runs of sorted batches, which are folded side by side: one numpy step for the i-th row of each.

    Runs may go on in the next batch; only the state of the last one has to be kept.
    """

    def __init__(self) -> None:
        self.key = None

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
        """First row and length of each run of a batch, and whether the first one goes on from the batch before."""
        hosts, stretches = batch.column("host_id").dictionary_encode().indices, batch.column("stretch")
        marks = np.stack([hosts.fill_null(-1).to_numpy(), stretches.fill_null(-1).to_numpy()])
        first = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)])
        goes_on = self.key == (batch.column("host_id")[0].as_py(), stretches[0].as_py())
        self.key = (batch.column("host_id")[-1].as_py(), stretches[-1].as_py())
        return first, np.diff(first, append=len(batch)), goes_on


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(m).to_numpy(zero_copy_only=False) for m in METRICS], axis=1)


def _fold(alpha: float) -> Callable:
    """One row for each run: its length, the state it would leave as a host's first, and its own mean and variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = Runs(), None

        def rows(keys: tuple[list, list], k: np.ndarray, state: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(k, pa.int64()),
                 *[pa.array(list(s), pa.list_(pa.float64())) for s in state]], ["host_id", "stretch", "k", *_PARTS])

        for batch in batches:
            if not len(batch):
                continue
            first, sizes, goes_on = runs.of(batch)
            x = _values(batch)
            state = [np.full((len(first), len(METRICS)), v) for v in (np.nan, 0.0, 0.0, 0.0)]
            done = np.zeros(len(first), np.int64)
            if goes_on:
                done[0] = held[1][0]
                for s, before in zip(state, held[2], strict=True):
                    s[0] = before[0]
            elif held:
                yield rows(*held)
            for i in range(int(sizes.max())):
                on = np.flatnonzero(sizes > i)
                mean, var, own_mean, own_var = (s[on] for s in state)
                now = x[first[on] + i]
                _, mean, var = stepped(mean, var, now, alpha)
                # weight of the run so far, and of this row in it
                weight = (1 - (1 - alpha) ** done[on]) * (1 - alpha)
                share = (alpha / (weight + alpha))[:, None]
                apart = now - own_mean
                own_mean, own_var = own_mean + share * apart, (1 - share) * (own_var + share * apart * apart)
                for s, new in zip(state, (mean, var, own_mean, own_var), strict=True):
                    s[on] = new
                done[on] += 1
            ids, stretches = (batch.column(c).take(pa.array(first)).to_pylist() for c in ("host_id", "stretch"))
            if len(first) > 1:
                yield rows((ids[:-1], stretches[:-1]), done[:-1], [s[:-1] for s in state])
            held = ((ids[-1:], stretches[-1:]), done[-1:], [s[-1:] for s in state])
        if held:
            yield rows(*held)
    return run


def _seeds(alpha: float) -> Callable:
    """From the folded runs of a host, the state that each starts from."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("stretch")
        k = table.column("k").to_pylist()
        parts = [np.array(table.column(p).to_pylist()) for p in _PARTS]
        mean, var = np.full(len(METRICS), np.nan), np.zeros(len(METRICS))
        out = []
        for i, n in enumerate(k):
            out.append((mean, var))
            first_mean, first_var, own_mean, own_var = (p[i] for p in parts)
            mean, var = (first_mean, first_var) if i == 0 else mixed(mean, var, own_mean, own_var, (1 - alpha) ** n)
        kind = pa.list_(pa.float64())
        return pa.table({
            "seed_host": table.column("host_id"), "seed_stretch": table.column("stretch"),
            "seed_mean": pa.array([list(m) for m, _ in out], kind), "seed_var": pa.array([list(v) for _, v in out], kind)})
    return run


def _score(alpha: float, min_abs: float) -> Callable:
    """Scores of sorted rows that carry the state their run starts from."""
    names = [f"z_{m}" for m in METRICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = Runs(), None
        for batch in batches:
            if not len(batch):
                continue
            first, sizes, goes_on = runs.of(batch)
            x, z = _values(batch), np.zeros((len(batch), len(METRICS)))
            mean, var = (np.array(batch.column(c).take(pa.array(first)).to_pylist(), float) for c in ("seed_mean", "seed_var"))
            if goes_on:
                mean[0], var[0] = held
            for i in range(int(sizes.max())):
                on = np.flatnonzero(sizes > i)
                z[first[on] + i], mean[on], var[on] = stepped(mean[on], var[on], x[first[on] + i], alpha)
            held = mean[-1], var[-1]
            keep = (np.abs(z) >= min_abs).any(axis=1) if min_abs > 0 else np.ones(len(z), bool)
            if keep.any():
                rows = batch.select(KEY).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(z[keep, i]) for i in range(len(METRICS))]], [*KEY, *names])
    return run


def zscores(profiles: DataFrame, alpha: float = 0.2, min_abs: float = 0.0, stretch_sec: int = STRETCH_SEC) -> DataFrame:
    """Z-scores of every profile, against its host's profiles before it in (end, window type, start) order.

    A stretch holds the windows of a host that end within ``stretch_sec``; its number of rows is bounded by the window
    settings, and a host has one folded row for each. Only rows with some ``|z| >= min_abs`` are returned. A host's first
    profile, and one whose host did not vary before, scores 0.
    The exchange of the profiles is run once for both passes.
    """
    slim = profiles.select(
        *KEY, *[F.col(m).cast("double").alias(m) for m in METRICS], window_type_code("window_type").alias("kind"),
        F.floor(F.unix_micros("window_end") / F.lit(stretch_sec * 1_000_000)).alias("stretch"))
    dealt = slim.repartition("host_id", "stretch")
    order = ["host_id", "stretch", "window_end", "kind", "window_start"]
    folds = dealt.sortWithinPartitions(*order).mapInArrow(_fold(alpha), _FOLDS)
    seeds = folds.groupBy("host_id").applyInArrow(
        _seeds(alpha), "seed_host string, seed_stretch long, seed_mean array<double>, seed_var array<double>")
    # null-safe on both sides: no filter is inferred, so the exchange is the same in both branches and is run once
    same = F.col("host_id").eqNullSafe(F.col("seed_host")) & F.col("stretch").eqNullSafe(F.col("seed_stretch"))
    seeded = dealt.join(seeds, same)
    return seeded.drop("seed_host", "seed_stretch").sortWithinPartitions(*order).mapInArrow(_score(alpha, min_abs), SCORED)


def zscore_hits(z_threshold: float):
    """The hit column over rows that carry ``z_<metric>``: only deviating metrics count."""
    flagged = [F.when(F.abs(F.col(f"z_{m}")) >= z_threshold, F.round(f"z_{m}", 2)).alias(m) for m in METRICS]
    highest = F.greatest(*[F.abs(z) for z in flagged])
    risk = F.least(F.lit(1.0), highest / F.lit(z_threshold * 2))
    details = F.struct(F.struct(*flagged).alias("z_scores"), F.lit(float(z_threshold)).alias("threshold"))
    return F.when(highest.isNotNull(), hit("ml:zscore", "anomaly", graded(risk, 0.6), risk, details))


def zscore_alerts(profiles: DataFrame, z_threshold: float = 4.0, alpha: float = 0.2) -> DataFrame:
    return alerts_of(zscores(profiles, alpha, z_threshold), [zscore_hits(z_threshold)])
