"""Profiles over a stream of packets, emitted once when the watermark has passed a window.

A packet is reduced in two or three chained aggregations in append mode. The first one keeps, per
host and pane, one row of state per distinct address, port and time slice, so the state of a busy
host is spread over all tasks and the only list is the times of one host within one slice. The
next ones count those rows per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import MICROS, limbs, profile_columns, squared_limbs
from ..settings import WindowSettings

SLICE, ADDRESS, PORT = 0, 1, 2


def _gap_squares(times: Column) -> Column:
    """Sum of squared gaps of a sorted array of times."""
    steps = F.zip_with(F.slice(times, 2, F.size(times)), times, lambda b, a: (b - a) * (b - a))
    return F.aggregate(F.filter(steps, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda acc, x: acc + x)


def stream_cells(packets: DataFrame, pane_sec: int, slice_sec: int, watermark_sec: float) -> DataFrame:
    """Closed (host, pane, kind, value) rows: every distinct address and port, and every time slice.

    Slices also carry the counts, first and last time and squared gaps of their packets.
    """
    us, size = F.unix_micros("ts"), F.lit(slice_sec * MICROS)
    values = F.array(
        F.struct(F.lit(SLICE).alias("kind"), (us - F.pmod(us, size)).alias("value"), us.alias("us")),
        F.struct(F.lit(ADDRESS).alias("kind"), F.col("dst_ip").cast("long").alias("value"), F.lit(None).cast("long").alias("us")),
        F.struct(F.lit(PORT).alias("kind"), F.col("dst_port").cast("long").alias("value"), F.lit(None).cast("long").alias("us")),
    )
    cells = (
        packets.withWatermark("ts", f"{watermark_sec} seconds")
        .select("host_id", "ts", "pkt_len", "protocol", F.inline(values))
        .groupBy("host_id", F.window("ts", f"{pane_sec} seconds").alias("pane"), "kind", "value")
        .agg(F.count("us").alias("packets"),
             F.sum(F.when(F.col("kind") == SLICE, F.col("pkt_len").cast("long"))).alias("bytes"),
             F.count_if((F.col("kind") == SLICE) & (F.col("protocol") == 6)).alias("tcp"),
             F.count_if((F.col("kind") == SLICE) & (F.col("protocol") == 17)).alias("udp"),
             F.array_sort(F.collect_list("us")).alias("times")))
    return cells.select(
        "host_id", "pane", "kind", "value", "packets", "bytes", "tcp", "udp",
        F.try_element_at("times", F.lit(1)).alias("first_us"), F.try_element_at("times", F.lit(-1)).alias("last_us"),
        _gap_squares(F.col("times")).alias("gap_sq"))


def _merged_gaps(parts: Column) -> Column:
    """Squared gaps inside and between the slices of a window, as (gap_high, gap_low)."""
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("gap_high"), none.alias("gap_low"), F.lit(None).cast("long").alias("last_us"))

    def add(acc: Column, part: Column) -> Column:
        high, low = limbs(part["gap_sq"])
        between_high, between_low = squared_limbs(F.coalesce(part["first_us"] - acc["last_us"], none))
        return F.struct(
            (acc["gap_high"] + high + between_high).alias("gap_high"), (acc["gap_low"] + low + between_low).alias("gap_low"),
            part["last_us"].alias("last_us"))

    return F.aggregate(F.array_sort(parts), start, add)


def closed_windows(packets: DataFrame, kind: str, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Merged counts and gaps of the closed tumbling or sliding windows of a stream."""
    s = settings
    size, step = (s.tumbling_sec, s.tumbling_sec) if kind == "tumbling" else (s.sliding_sec, s.sliding_step_sec)
    pane = s.pane_sec((kind,))
    cells = stream_cells(packets, pane, s.stream_slice_sec(pane), s.watermark_sec)
    numbers = ["packets", "bytes", "tcp", "udp", "first_us", "last_us", "gap_sq"]
    if pane == size == step:
        windowed = cells.withColumnRenamed("pane", "win")
    else:  # the same address or port may be in several panes of the window
        windowed = cells.withColumn("at", F.window_time("pane")).groupBy(
            "host_id", F.window("at", f"{size} seconds", f"{step} seconds").alias("win"), "kind", "value",
        ).agg(*[F.max(n).alias(n) for n in numbers])
    part = F.struct("first_us", "last_us", "gap_sq")
    merged = windowed.groupBy("host_id", "win").agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
        F.sum("tcp").alias("tcp"), F.sum("udp").alias("udp"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.count_if(F.col("kind") == ADDRESS).alias("uniq_dst_ip"),
        F.count_if(F.col("kind") == PORT).alias("uniq_dst_port"),
        F.collect_list(F.when(F.col("kind") == SLICE, part)).alias("parts"))
    closed = merged.withColumn("gaps", _merged_gaps(F.col("parts"))).select(
        "host_id", F.lit(kind).alias("window_type"), F.unix_micros(F.col("win.start")).alias("start_us"),
        F.unix_micros(F.col("win.end")).alias("end_us"), "first_us", "last_us", "packets", "bytes", "tcp", "udp",
        "gaps.gap_high", "gaps.gap_low", "uniq_dst_ip", "uniq_dst_port")
    return closed.where(F.col("start_us") >= 0) if kind == "sliding" else closed


def fixed_profiles(packets: DataFrame, kind: str, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Closed tumbling or sliding profiles of a stream."""
    return closed_windows(packets, kind, settings).select(*profile_columns(settings.min_duration_sec))
