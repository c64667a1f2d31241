"""Long-running jobs: packets to profiles and alerts, message queues to tables, late packets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .. import schemas
from ..functions.scalars import window_type_code
from ..operators import windows as W
from ..operators.alerts import alerts_of
from ..operators.detector import Detector
from ..operators.registry import ZScore, score_safely
from ..operators.zscore import KEY, METRICS, SCORED, advance, zscore_hits
from ..plans import store, workspace
from ..settings import Topics, WindowSettings
from ..sources import rows
from .runs import stream_settings
from . import hosts, scores
from .sessions import late_counts, merge_shares

BatchSink = Callable[[DataFrame, int], None]


def start(
    stream: DataFrame, sink: BatchSink, checkpoint: str, available_now: bool = False, every: str = "10 seconds", state_partitions: int | None = None,
) -> StreamingQuery:
    """Run ``sink(batch, batch_id)`` for every micro-batch. A batch may be repeated after a failure."""
    writer = stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    with stream_settings(stream.sparkSession, state_partitions):
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def table_sinks(profiles_path: str, alerts_path: str) -> tuple[BatchSink, BatchSink]:
    """Put profiles and alerts into their tables; a repeated batch replaces what it wrote before."""
    return (lambda df, batch: store.load_profiles(df, profiles_path, batch),
            lambda df, batch: store.load_alerts(store.alert_rows(df), alerts_path, batch))


def topic_sinks(topics: Topics = Topics()) -> tuple[BatchSink, BatchSink]:
    """Publish profiles and alerts as JSON messages."""
    return (lambda df, _: rows.publish(rows.profiles_as_json(df), topics.profiles, topics),
            lambda df, _: rows.publish(rows.alerts_as_json(df), topics.alerts, topics))


def live(
    packets: DataFrame, detectors: list[Detector], sinks: tuple[BatchSink, BatchSink], checkpoint: str,
    settings: WindowSettings = WindowSettings(), shares: int = 16, available_now: bool = False, state_partitions: int | None = None,
    on_late: BatchSink | None = None,
) -> StreamingQuery:
    """Profiles of all three windows and their alerts, from a stream of packets.

    One query holds all windows, so each table has one writer. Window state lives in the checkpoint, and a restart goes
    on with the open windows. What comes too late for a window that was reported is reported as a newer profile of that window, and
    ``on_late`` gets (host_id, packets) with the packets behind the watermark. A detector that fails while it scores a
    batch is logged and left out of that batch. Z-scores are folded in order by a second stateful operator, at most one
    timeout after a window is closed; late parts are not folded.
    """
    folding = [d for d in detectors if isinstance(d, ZScore)]
    others = [d for d in detectors if not isinstance(d, ZScore)]
    if len(folding) > 1:
        raise ValueError("a live query keeps one state of z-scores")
    on_profiles, on_alerts = sinks
    if folding:
        rows = scores.scored_rows(packets, settings, shares, folding[0].alpha)
    else:
        rows = hosts.closed_rows(packets, settings, shares)

    def handle(batch_rows: DataFrame, batch: int) -> None:
        found = workspace.written(batch_rows, "closed_windows")  # stateful operators run once
        closed = found.where("z is null").drop("z") if folding else found
        profiles = workspace.written(merge_shares(closed, settings), "closed_profiles")
        on_profiles(profiles, batch)
        alerts = score_safely(profiles, others)
        if folding:
            alerts = alerts.unionByName(alerts_of(scores.zscore_columns(found), [zscore_hits(folding[0].z_threshold)]))
        on_alerts(alerts, batch)
        if on_late:
            on_late(late_counts(closed), batch)

    return start(rows, handle, checkpoint, available_now, state_partitions=state_partitions)


def load_tables(messages: DataFrame, schema: T.StructType, path: str, ts: str, key: list[str], checkpoint: str,
                quarantine: str | None = None, available_now: bool = False) -> StreamingQuery:
    """JSON messages to a stored table; unusable ones go to ``quarantine`` and never stop the query."""

    def load(batch: DataFrame, batch_id: int) -> None:
        checked = rows.check_rows(batch, schema).persist()
        store.load_rows(checked.where(F.col("error").isNull()).select(*schema.names), path, ts, key, batch_id)
        if quarantine:
            bad = checked.where(F.col("error").isNotNull()).select("value", "error", F.lit(batch_id).alias("batch_id"))
            bad.write.mode("append").parquet(quarantine)
        checked.unpersist()

    return start(messages, load, checkpoint, available_now)


class HostZScores(StatefulProcessor):
    """Keeps eight numbers per host: mean and variance of the four metrics.

    It also keeps, for each kind of window, the newest one that was folded. Windows of a kind close in order, so a
    profile that is not newer is a copy (of a repeated batch) or a late part, and changes nothing.
    """

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle) -> None:
        self.state = handle.getValueState("ewma", "numbers array<double>")
        self.newest = handle.getMapState("newest", "kind int", "window_end long, window_start long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["window_end", "kind", "window_start"])
        state = list(self.state.get()[0]) if self.state.exists() else None
        batch = batch[self._new(batch)]
        scores = []
        for values in batch[METRICS].to_numpy().tolist():
            state, z = advance(state, values, self.alpha)
            scores.append(z)
        if scores:
            self.state.update((state,))
        yield batch[KEY].assign(**{f"z_{m}": [z[i] for z in scores] for i, m in enumerate(METRICS)})


    def _new(self, batch: pd.DataFrame) -> pd.Series:
        """Which rows, in order, are newer than all before them of their kind."""
        keep = pd.Series(False, index=batch.index)
        for kind, rows in batch.groupby("kind"):
            ends, starts = (rows[c].astype("int64").tolist() for c in ("window_end", "window_start"))
            last = tuple(self.newest.getValue((int(kind),))) if self.newest.containsKey((int(kind),)) else None
            for place, own in zip(rows.index, zip(ends, starts)):
                if last is None or own > last:
                    keep[place], last = True, own
            self.newest.updateValue((int(kind),), last)
        return keep


def stream_zscore_alerts(profiles: DataFrame, z_threshold: float = 4.0, alpha: float = 0.2) -> DataFrame:
    """Z-score alerts over a stream of profiles; within a micro-batch a host's profiles are put in order."""
    slim = profiles.select(*KEY, *[F.col(m).cast("double").alias(m) for m in METRICS], window_type_code("window_type").alias("kind"))
    scored = slim.groupBy("host_id").transformWithStateInPandas(HostZScores(alpha), SCORED, "Append", "None")
    return alerts_of(scored, [zscore_hits(z_threshold)])


def live_zscores(spark: SparkSession, profiles_path: str, on_alerts: BatchSink, checkpoint: str,
                 z_threshold: float = 4.0, alpha: float = 0.2, available_now: bool = False) -> StreamingQuery:
    """Z-score alerts from the profile table that ``live`` fills, all window types in one state per host.

    Give them a table of their own: two queries must not append to one folder at the same time.
    """
    profiles = read_table(spark, profiles_path, schemas.PROFILES)
    return start(stream_zscore_alerts(profiles, z_threshold, alpha), on_alerts, checkpoint, available_now)


def reemit_late(
    packets: DataFrame, sink: BatchSink, marks_path: str, checkpoint: str,
    settings: WindowSettings = WindowSettings(), available_now: bool = False,
) -> StreamingQuery:
    """Partial tumbling and sliding profiles from packets whose window had already been closed.

    Opt-in next to ``live``, which drops such packets. The highest time of every batch is kept in a
    small table, so a repeated batch sees the same watermark. The partial profile has a newer
    version and replaces the full one when the newest version is read.
    """
    spark = packets.sparkSession
    top_type = "batch_id long, top_us long"

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        top = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
        if batch_id > 0:  # the mark of the batch before holds the highest time of all batches up to it
            seen = spark.read.schema(top_type).parquet(f"{marks_path}/part={batch_id - 1}").agg(F.max("top_us")).first()[0]
            if seen is not None:
                watermark = F.timestamp_micros(F.lit(int(seen - settings.watermark_sec * 1_000_000)))
                late = batch.where(F.col("ts") < watermark)
                partial = W.profiles(late, settings, ("tumbling", "sliding"))
                sink(W.closed_profiles(partial, watermark, settings.session_timeout_sec), batch_id)
                top = seen if top is None else max(top, seen)
        spark.createDataFrame([(batch_id, top)], top_type).coalesce(1).write.mode("overwrite").parquet(f"{marks_path}/part={batch_id}")
        workspace.remove(spark, f"{marks_path}/part={batch_id - 2}")
        batch.unpersist()

    return start(packets, emit, checkpoint, available_now)


def read_table(spark: SparkSession, path: str, schema: T.StructType, files: int = 256) -> DataFrame:
    """A stored table as a stream of its new files, a bounded number in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
