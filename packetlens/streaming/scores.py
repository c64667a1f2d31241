"""Z-scores inside a streaming query: a reorder buffer behind the window operator.

A host's profiles must be folded in (end, window type, start) order, but a session is closed up to the timeout later than a
fixed window that ends at the same time. The buffer keeps what was closed until the watermark is more than the timeout
past its end; then nothing that ends earlier can come any more, and it is folded in order, batch after batch. Event-time
timers call hosts that send nothing. State per host: the mean and variance of four metrics, and the windows of the
last timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.windows import ALL_KINDS, MICROS
from ..operators.zscore import METRICS, advance
from ..settings import WindowSettings
from .hosts import _CLOSED_NAMES, CLOSED, LATE, closed_rows

SCORED = f"{CLOSED}, z array<double>"
_PARTS = ["start_us", "end_us", "packets", "bytes", "uniq_dst_ip", "uniq_dst_port"]
_WAITING = "kind array<long>, " + ", ".join(f"{p} array<long>" for p in _PARTS)
_CODES = {name: code for code, name in enumerate(ALL_KINDS)}


class HostScores(StatefulProcessor):
    """Passes closed windows on, and adds a row with scores for each window once its turn has come."""

    def __init__(self, timeout_us: int, min_duration_sec: float, alpha: float) -> None:
        self.timeout_us, self.min_duration_sec, self.alpha = timeout_us, min_duration_sec, alpha

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _WAITING)
        self.ewma = handle.getValueState("ewma", "numbers array<double>")
        self.turn = handle.getValueState("turn", "folded_us long, timer_ms long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for frame in rows:
            yield frame.assign(z=None)
            own = frame[frame["window_type"] != LATE]
            parts.append(np.stack([own["window_type"].map(_CODES).to_numpy(np.int64), *(own[p].to_numpy(np.int64) for p in _PARTS)]))
        yield self._score(key[0], parts, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._score(key[0], [], timerValues)

    def _score(self, host: str, parts: list[np.ndarray], timerValues) -> pd.DataFrame:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        folded, timer = tuple(self.turn.get()) if self.turn.exists() else (-(1 << 62), -1)
        # late parts of windows that were folded change nothing
        parts = [p[:, p[2] >= folded] for p in parts]
        if self.waiting.exists():
            parts.append(np.array(self.waiting.get(), np.int64))
        held = self._merged(np.concatenate(parts, axis=1)) if parts else np.zeros((1 + len(_PARTS), 0), np.int64)
        folded = max(folded, watermark - self.timeout_us)
        ready, rest = held[:, held[2] < folded], held[:, held[2] >= folded]
        out = self._folded(host, ready)
        if rest.shape[1]:
            self.waiting.update(tuple(r.tolist() for r in rest))
        elif self.waiting.exists():
            self.waiting.clear()
        now = max(int(rest[2].min() + self.timeout_us) // 1000, watermark // 1000 + 1) if rest.shape[1] else -1
        if now != timer:
            if timer >= 0 and timer in set(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if now >= 0:
                self.handle.registerTimer(now)
        self.turn.update((folded, now))
        return out

    @staticmethod
    def _merged(rows: np.ndarray) -> np.ndarray:
        """The shares of each window added up, windows in order."""
        keys, which = np.unique(rows[[2, 0, 1]], axis=1, return_inverse=True)
        out = np.zeros((len(rows), keys.shape[1]), np.int64)
        out[[2, 0, 1]] = keys
        for k in range(3, len(rows)):
            np.add.at(out[k], which.ravel(), rows[k])
        return out

    def _folded(self, host: str, rows: np.ndarray) -> pd.DataFrame:
        state = list(self.ewma.get()[0]) if self.ewma.exists() else None
        kind, start, end, packets, size, ips, ports = rows
        duration = np.maximum((end - start) / MICROS, self.min_duration_sec)
        scores = []
        for values in zip(*((x / y).tolist() for x, y in ((packets, duration), (size * 8, duration), (ips, 1), (ports, 1))), strict=True):
            state, z = advance(state, list(values), self.alpha)
            scores.append(z)
        if scores:
            self.ewma.update((state,))
        blank = dict.fromkeys(_CLOSED_NAMES, 0) | {"host_id": host}
        return pd.DataFrame(blank | {
            "window_type": [ALL_KINDS[k] for k in kind], "start_us": start, "end_us": end, "z": scores}, index=range(len(scores)),
            columns=[*_CLOSED_NAMES, "z"])


def scored_rows(packets: DataFrame, settings: WindowSettings = WindowSettings(), shares: int = 16, alpha: float = 0.2) -> DataFrame:
    """``closed_rows`` (z is null), and a row with the z-scores of each window when all that end before it are closed."""
    processor = HostScores(settings.session_timeout_sec * MICROS, settings.min_duration_sec, alpha)
    return closed_rows(packets, settings, shares).groupBy("host_id").transformWithStateInPandas(processor, SCORED, "Append", "EventTime")


def zscore_columns(scored: DataFrame) -> DataFrame:
    """Rows with scores as ``operators.zscore.zscores`` gives them."""
    start, end = F.timestamp_micros("start_us").alias("window_start"), F.timestamp_micros("end_us").alias("window_end")
    return scored.where("z is not null").select(
        "host_id", start, end, "window_type", *[F.col("z")[i].alias(f"z_{m}") for i, m in enumerate(METRICS)])
