"""Profiles from closed windows of a stream; one row per window, host and share before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import profile_columns
from ..settings import WindowSettings
from .hosts import LATE, closed_rows


def session_shares(packets: DataFrame, settings: WindowSettings = WindowSettings(), shares: int = 16) -> DataFrame:
    """Closed sessions of a stream, in ``shares`` rows each.

    A session is over once the watermark is more than the timeout past its last packet.
    """
    return closed_rows(packets, settings, shares, ("session",)).where(F.col("window_type") != LATE)


def merge_shares(rows: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Profiles from the closed windows of a batch, or of a whole table of them. Counts of late packets are left out."""
    counts = ["packets", "bytes", "tcp", "udp", "gap_high", "gap_low", "uniq_dst_ip", "uniq_dst_port"]
    return rows.where(F.col("window_type") != LATE).groupBy("host_id", "window_type", "start_us", "end_us").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        *[F.sum(c).alias(c) for c in counts]).select(*profile_columns(settings.min_duration_sec))


def late_counts(rows: DataFrame) -> DataFrame:
    """(host_id, packets): packets that came after the watermark had passed them."""
    return rows.where(F.col("window_type") == LATE).groupBy("host_id").agg(F.sum("packets").alias("packets"))
