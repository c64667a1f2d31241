"""Profiles: one row per host and tumbling, sliding or session window.

How a profile is put together, so that no group grows with the traffic of a host:

* *segments*: packets are ordered within (host, slice), a few seconds each, and every slice is
  reduced to counts, first and last time and the exact sum of squared gaps. The source is scanned once for
  segments and once for arrivals, which drop copies of a value before they are shuffled.
* segments of a host are chained: ``lag`` gives the last packet before each segment, which yields
  the gap between segments and the session each one belongs to. A host has at most one segment per
  slice of time, however many packets it sends.
* *arrivals*: distinct (host, address or port, pane) cells, each with the pane its value was last
  seen in. A value counts in a window exactly if that earlier pane lies before the window, so the
  distinct counts of all overlapping windows are plain sums and no set is ever built. Values that
  are new to no window drop out at once; the rest are counted per pane.

Segments and arrivals, a few rows per host and pane by now, meet in one ``groupBy`` per host and
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import workspace
from ..settings import WindowSettings

ALL_KINDS = ("tumbling", "sliding", "session")
MICROS = 1_000_000


# A sum of squares is carried as two 64-bit sums: value = high * 2**30 + low. It is exact for windows
# of up to two years and needs no wide decimals while rows are added up.
_LIMB = 30
_MASK = 2**_LIMB - 1


def limbs(square: Column) -> tuple[Column, Column]:
    return F.shiftright(square, _LIMB), square.bitwiseAND(F.lit(_MASK))


def squared_limbs(x: Column) -> tuple[Column, Column]:
    """``x * x`` for values whose square does not fit 64 bits."""
    a, b = limbs(x)
    high, low = limbs(b * b)
    return a * a * F.lit(2**_LIMB) + a * b * 2 + high, low


def _floor_to(us: Column, size_us: int) -> Column:
    return us - F.pmod(us, F.lit(size_us))


def _ceil_to(us: Column, size_us: int) -> Column:
    return us + F.pmod(-us, F.lit(size_us))


def _sliding_starts(pane: Column, pane_us: int, size_us: int, step_us: int, newest: Column | None = None) -> Column:
    """Starts of the sliding windows (none before the epoch) that cover a pane; only the ``newest`` of them if given."""
    first = F.greatest(_ceil_to(pane - F.lit(size_us - pane_us), step_us), F.lit(0))
    last = _floor_to(pane, step_us)
    if newest is not None:
        first = F.greatest(first, last - (newest - 1) * F.lit(step_us))
    return F.when(first <= last, F.sequence(first, last, F.lit(step_us)))


def _with_previous(rows: DataFrame, slot: str, timeout_us: int | None) -> DataFrame:
    """Add ``prev_us`` (last packet of the host before this slot) and, with a timeout, ``session_us``."""
    by_host = Window.partitionBy("host_id").orderBy(slot)
    rows = rows.withColumn("prev_us", F.lag("last_us").over(by_host))
    if timeout_us is None:
        return rows
    opens = F.col("prev_us").isNull() | (F.col("first_us") - F.col("prev_us") > F.lit(timeout_us))
    so_far = by_host.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("session_us", F.max(F.when(opens, F.col("first_us"))).over(so_far))


def segments(packets: DataFrame, slice_sec: int) -> DataFrame:
    """One row per (host, slice): counts, first and last time, sum of squared gaps in square µs."""
    us = F.unix_micros("ts")
    rows = packets.select(
        "host_id", us.alias("us"), _floor_to(us, slice_sec * MICROS).alias("slice_us"),
        F.col("pkt_len").cast("long").alias("pkt_len"), F.col("protocol").cast("int").alias("protocol"),
    )
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("host_id", "slice_us").orderBy("us"))
    return rows.withColumn("gap", gap).groupBy("host_id", "slice_us").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("pkt_len").alias("bytes"),
        F.count_if(F.col("protocol") == 6).alias("tcp"),
        F.count_if(F.col("protocol") == 17).alias("udp"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).alias("gap_sq"),
    )


def _panes(packets: DataFrame, s: WindowSettings, kinds: tuple[str, ...]) -> DataFrame:
    """Segments chained per host and merged to panes (still partitioned by host, no new shuffle)."""
    pane_us = s.pane_sec(kinds) * MICROS
    timeout_us = s.session_timeout_sec * MICROS if "session" in kinds else None
    chained = _with_previous(segments(packets, s.order_slice_sec(kinds)), "slice_us", timeout_us)
    bridge = F.col("first_us") - F.col("prev_us")
    inside = F.col("prev_us") >= F.col("pane_us")
    columns = [
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
        F.sum("tcp").alias("tcp"), F.sum("udp").alias("udp"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.sum(F.col("gap_sq") + F.when(inside, bridge * bridge).otherwise(0)).alias("gap_sq"),
        F.min(F.coalesce("prev_us", F.lit(-(2**62)))).alias("prev_us"),
    ]
    if timeout_us is not None:
        columns.append(F.min("session_us").alias("session_us"))
    return chained.withColumn("pane_us", _floor_to(F.col("slice_us"), pane_us)).groupBy("host_id", "pane_us").agg(*columns)


def _windows_of(s: WindowSettings, kinds: tuple[str, ...]) -> Column:
    """Array of (window_type, start_us) that a pane row belongs to."""
    pane, parts = F.col("pane_us"), []

    def entry(kind: str, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("window_type"), start.alias("start_us"))

    if "tumbling" in kinds:
        parts.append(F.array(entry("tumbling", _floor_to(pane, s.tumbling_sec * MICROS))))
    if "sliding" in kinds:
        starts = _sliding_starts(
            pane, s.pane_sec(kinds) * MICROS, s.sliding_sec * MICROS, s.sliding_step_sec * MICROS)
        parts.append(F.transform(F.coalesce(starts, F.array().cast("array<bigint>")), lambda x: entry("sliding", x)))
    if "session" in kinds:
        parts.append(F.array(entry("session", F.col("session_us"))))
    return F.concat(*parts)


def cells(packets: DataFrame, pane_sec: int) -> DataFrame:
    """Distinct (host, address or port, pane), each with the pane its value was last seen in."""
    pane = _floor_to(F.unix_micros("ts"), pane_sec * MICROS)
    values = F.array(
        F.struct(F.lit(False).alias("is_port"), F.col("dst_ip").cast("long").alias("value")),
        F.struct(F.lit(True).alias("is_port"), F.col("dst_port").cast("long").alias("value")),
    )
    distinct = packets.select("host_id", pane.alias("pane_us"), F.inline(values)).distinct()
    seen = Window.partitionBy("host_id", "is_port", "value").orderBy("pane_us")
    return distinct.withColumn("seen_us", F.lag("pane_us").over(seen)).select("host_id", "is_port", "pane_us", "seen_us")


def _arrivals(packets: DataFrame, panes: DataFrame, s: WindowSettings, kinds: tuple[str, ...]) -> DataFrame:
    """(host, window) rows with the number of addresses and ports that a pane adds to the window."""
    pane_us, timeout_us = s.pane_sec(kinds) * MICROS, s.session_timeout_sec * MICROS
    size_us, step_us = s.sliding_sec * MICROS, s.sliding_step_sec * MICROS
    found = cells(packets, s.pane_sec(kinds))
    pane, seen, parts = F.col("pane_us"), F.col("seen_us"), []
    counts = [F.count_if(~F.col("is_port")).alias("new_ips"), F.count_if(F.col("is_port")).alias("new_ports")]

    # A value is new to the tumbling window if it was last seen before its start, and to the newest
    # ``fresh`` of the sliding windows, those that start later than the pane it was last seen in.
    most = -(-size_us // step_us)
    in_tumbling = seen.isNull() | (seen < _floor_to(pane, s.tumbling_sec * MICROS)) if "tumbling" in kinds else F.lit(False)
    fresh = F.lit(0)
    if "sliding" in kinds:
        passed = (_floor_to(pane, step_us) - _floor_to(seen, step_us)) / F.lit(step_us)
        fresh = F.coalesce(F.least(passed.cast("int"), F.lit(most)), F.lit(most))
    if "tumbling" in kinds or "sliding" in kinds:
        new = found.select("host_id", "is_port", "pane_us", in_tumbling.alias("in_tumbling"), fresh.alias("fresh"))
        new = new.where(F.col("in_tumbling") | (F.col("fresh") > 0))
        # few rows per pane are left, so they can be put with the other rows of their host
        new = new.groupBy("host_id", "pane_us", "in_tumbling", "fresh").agg(*counts).repartition("host_id")
        starts = _sliding_starts(pane, pane_us, size_us, step_us, newest=F.col("fresh"))
        none = F.array().cast("array<struct<window_type:string,start_us:bigint>>")

        def entry(kind: str, start: Column) -> Column:
            return F.struct(F.lit(kind).alias("window_type"), start.alias("start_us"))

        of_pane = F.concat(
            F.when(F.col("in_tumbling"), F.array(entry("tumbling", _floor_to(pane, s.tumbling_sec * MICROS)))).otherwise(none),
            F.when(F.col("fresh") > 0, F.coalesce(F.transform(starts, lambda x: entry("sliding", x)), none)).otherwise(none))
        parts.append(new.select("host_id", "new_ips", "new_ports", F.inline(of_pane)))
    if "session" in kinds:
        # Both panes lie in one session if all time between their far ends is within the timeout,
        # so only values that were away for longer have to be matched with the sessions.
        away = found.where(seen.isNull() | (pane + F.lit(pane_us) - seen > F.lit(timeout_us)))
        sessions = panes.select("host_id", "pane_us", "session_us")  # no session breaks inside a pane
        # every cell has its session; a left join infers no extra filter, so the exchange of the
        # cells is the same in both branches and is run once
        matched = away.join(sessions, ["host_id", "pane_us"], "left")
        new = matched.where(seen.isNull() | (seen < _floor_to(F.col("session_us"), pane_us)))
        parts.append(new.groupBy("host_id", F.col("session_us").alias("start_us")).agg(*counts).withColumn(
            "window_type", F.lit("session")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def interval_stats(packets: Column, first_us: Column, last_us: Column, gap_high: Column, gap_low: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation, in seconds, of the gaps between consecutive packets.

    The gaps add up to last - first, so only their squares have to be carried. With q the whole part
    and r the remainder of the mean, the squared distances from q add up to squares - q * (sum + r),
    which is taken in whole numbers; wide decimals serve only sums beyond 64 bits.
    """
    n, span = F.nullif(packets - 1, F.lit(0)), last_us - first_us
    whole = F.call_function("div", span, n)
    rest = span - whole * n
    small = gap_high * F.lit(2**_LIMB) + gap_low - whole * (span + rest)
    large = (gap_high.cast("decimal(20,0)") * F.lit(2**_LIMB).cast("decimal(11,0)") + gap_low
             - whole.cast("decimal(19,0)") * (span + rest).cast("decimal(19,0)"))
    around = F.when(gap_high < 2**32, small.cast("double")).otherwise(large.cast("double"))
    variance = F.greatest(around / n - (rest / n) * (rest / n), F.lit(0.0))
    zero = F.lit(0.0)
    return F.coalesce(span / n / MICROS, zero), F.coalesce(F.sqrt(variance) / MICROS, zero)


def profile_columns(min_duration_sec: float) -> list[Column]:
    """The profile columns from the merged window columns (``start_us``, ``end_us``, counts, gaps)."""
    duration = F.greatest((F.col("end_us") - F.col("start_us")) / MICROS, F.lit(float(min_duration_sec)))
    mean, std = interval_stats(F.col("packets"), F.col("first_us"), F.col("last_us"), F.col("gap_high"), F.col("gap_low"))
    return [
        F.col("host_id"),
        F.timestamp_micros("start_us").alias("window_start"),
        F.timestamp_micros("end_us").alias("window_end"),
        F.col("window_type"),
        F.col("packets"), F.col("bytes"),
        (F.col("packets") / duration).alias("pps"),
        (F.col("bytes") * 8 / duration).alias("bps"),
        F.col("uniq_dst_ip"), F.col("uniq_dst_port"),
        F.col("tcp").alias("proto_tcp"), F.col("udp").alias("proto_udp"),
        (F.col("packets") - F.col("tcp") - F.col("udp")).alias("proto_other"),
        mean.alias("conn_interval_avg"), std.alias("conn_interval_std"),
    ]


def end_of(s: WindowSettings) -> Column:
    """End of a window: start + size, or the last packet of a session."""
    return (F.when(F.col("window_type") == "tumbling", F.col("start_us") + F.lit(s.tumbling_sec * MICROS))
            .when(F.col("window_type") == "sliding", F.col("start_us") + F.lit(s.sliding_sec * MICROS))
            .otherwise(F.col("last_us")))


def profiles(packets: DataFrame, settings: WindowSettings = WindowSettings(), kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """Profiles of the windows named in ``kinds`` over a bounded table of packets."""
    s, zero, nothing = settings, F.lit(0).cast("long"), F.lit(None).cast("long")
    inner_high, inner_low = limbs(F.col("gap_sq"))
    high, low = squared_limbs(F.col("first_us") - F.col("prev_us"))
    inside = F.col("prev_us") >= F.col("start_us")
    panes = _panes(packets, s, kinds)
    if "session" in kinds:  # read twice below; a row per host and pane, where the packets would be read again
        panes = workspace.written(panes, "panes")
    traffic = panes.select("*", F.inline(_windows_of(s, kinds))).select(
        "host_id", "window_type", "start_us", "packets", "bytes", "tcp", "udp", "first_us", "last_us",
        (inner_high + F.when(inside, high).otherwise(zero)).alias("gap_high"),
        (inner_low + F.when(inside, low).otherwise(zero)).alias("gap_low"),
        zero.alias("new_ips"), zero.alias("new_ports"))
    values = _arrivals(packets, panes, s, kinds).select(
        "host_id", "window_type", "start_us", *[zero.alias(c) for c in ("packets", "bytes", "tcp", "udp")],
        nothing.alias("first_us"), nothing.alias("last_us"), zero.alias("gap_high"), zero.alias("gap_low"),
        "new_ips", "new_ports")
    merged = traffic.unionByName(values).groupBy("host_id", "window_type", "start_us").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.sum("new_ips").alias("uniq_dst_ip"), F.sum("new_ports").alias("uniq_dst_port"),
        *[F.sum(c).alias(c) for c in ("packets", "bytes", "tcp", "udp", "gap_high", "gap_low")])
    return merged.withColumn("end_us", end_of(s)).select(*profile_columns(s.min_duration_sec))


def tumbling_profiles(packets: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    return profiles(packets, settings, ("tumbling",))


def sliding_profiles(packets: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    return profiles(packets, settings, ("sliding",))


def session_profiles(packets: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    return profiles(packets, settings, ("session",))


def closed_profiles(rows: DataFrame, watermark: Column, session_timeout_sec: int) -> DataFrame:
    """Windows that a watermark has closed: end reached, or a session idle for more than the timeout."""
    over = F.unix_micros(watermark) - F.unix_micros("window_end")
    return rows.where(F.when(F.col("window_type") == "session", over > F.lit(session_timeout_sec * MICROS))
                      .otherwise(over >= 0))
