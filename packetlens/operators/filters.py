"""Row filters: capture scope, recent history, late packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import col

DIRECTIONS = ("ingress", "egress", "both")


def capture_scope(df: DataFrame, mode: str, direction: str = "both", ifindexes: list[int] | None = None) -> DataFrame:
    """Packets that a capture mode and direction would have seen."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}: use ingress, egress or both")
    one_way = F.lit(True) if direction == "both" else F.col("direction") == direction.upper()
    if mode == "interface":
        kept = (F.col("hook") == ("HOOK_XDP" if direction == "ingress" else "HOOK_TC")) & one_way
        if ifindexes is not None:
            kept = kept & F.col("ifindex").isin(list(ifindexes))
    elif mode == "cgroup":
        kept = (F.col("hook") == "HOOK_CGROUP_SKB") & one_way
    else:
        raise ValueError(f"unknown mode {mode!r}: use interface or cgroup")
    return df.where(kept)


def recent(df: DataFrame, as_of: Column, hours: int, ts: str = "window_start") -> DataFrame:
    """Rows of the last ``hours``; on a table split by day, older days are not read at all."""
    bound = as_of - F.make_interval(hours=F.lit(hours))
    kept = df.where(F.col(ts) >= bound)
    return kept.where(F.col("day") >= F.to_date(bound)) if "day" in df.columns else kept


def late_events(df: DataFrame, arrival: str, lag_sec: float, ts: Column | str = "ts", chunk: int = 1_000_000) -> DataFrame:
    """Add ``watermark_us`` (highest time that arrived before the row, less the lag) and ``is_late``.

    Rows are taken in ``arrival`` order over all hosts. The running maximum is found in three
    levels (within chunks of consecutive arrival numbers, over chunks, over groups of chunks), so
    that no task ever orders more than about ``chunk`` rows.
    """
    fan = max(int(chunk**0.5), 2)
    rows = df.withColumn("_us", F.unix_micros(col(ts))).withColumn("_chunk", _number_of(arrival, chunk))
    chunks = rows.groupBy("_chunk").agg(F.max("_us").alias("_top")).withColumn(
        "_group", _number_of("_chunk", chunk * fan))
    groups = chunks.groupBy("_group").agg(F.max("_top").alias("_group_top"))

    def before(within: list[str], order: str):
        return Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    groups = groups.select("_group", F.max("_group_top").over(before([], "_group")).alias("_earlier_groups"))
    chunks = chunks.withColumn("_earlier_chunks", F.max("_top").over(before(["_group"], "_chunk"))).join(
        groups, "_group", "left").select("_chunk", F.greatest("_earlier_chunks", "_earlier_groups").alias("_earlier"))
    seen = F.greatest(F.max("_us").over(before(["_chunk"], arrival)), F.col("_earlier"))
    # the clock starts at zero, as it does for the first packet of a run
    watermark = F.greatest(F.coalesce(seen, F.lit(0)), F.lit(0)) - F.lit(int(lag_sec * 1_000_000))
    joined = rows.join(chunks, "_chunk", "left").withColumn("watermark_us", watermark)
    return joined.withColumn("is_late", F.col("_us") < F.col("watermark_us")).drop("_us", "_chunk", "_earlier")


def _number_of(column: str, size: int) -> Column:
    value = F.col(column)
    return value - F.pmod(value, F.lit(size))
