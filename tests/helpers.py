"""Small packet tables and a direct accumulation to check profiles against."""

from __future__ import annotations

from datetime import datetime, timezone
from math import sqrt

from pyspark.sql import functions as F

from packetlens import schemas


def packets(spark, rows):
    """(host, seconds[, dst_ip, dst_port, pkt_len, protocol]) rows as a packets table."""
    full = [(r[0], int(round(r[1] * 1_000_000)), *(*r[2:], *(1, 80, 100, 6)[len(r) - 2:])) for r in rows]
    df = spark.createDataFrame(full, "host_id string, us long, dst_ip long, dst_port int, pkt_len int, protocol int")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def when(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def seconds(value: datetime) -> float:
    return (value - datetime(1970, 1, 1)).total_seconds()


def profile(spark, **changes):
    """The base profile of the rule cases, with changes."""
    base = {
        "host_id": "h1", "window_start": when(0), "window_end": when(60), "window_type": "tumbling",
        "packets": 10, "bytes": 1000, "pps": 1.0, "bps": 1000.0, "uniq_dst_ip": 1, "uniq_dst_port": 1,
        "proto_tcp": 10, "proto_udp": 0, "proto_other": 0, "conn_interval_avg": 0.0, "conn_interval_std": 0.0,
    }
    row = {**base, **changes}
    return spark.createDataFrame([tuple(row[n] for n in schemas.PROFILES.names)], schemas.PROFILES)


def windows_of(us, last_session, s):
    """(type, start, end) of the fixed windows of a time in µs."""
    size = s.tumbling_sec * 1_000_000
    yield "tumbling", us // size * size, us // size * size + size
    size, step = s.sliding_sec * 1_000_000, s.sliding_step_sec * 1_000_000
    for slot in range(max((us - size) // step + 1, 0), us // step + 1):
        yield "sliding", slot * step, slot * step + size
    yield "session", last_session, None


def accumulate(rows, s):
    """Profiles of in-memory rows (host, us, ip, port, length, protocol), one packet at a time."""
    groups, sessions = {}, {}
    for host, us, *rest in sorted(rows):
        start, last = sessions.get(host, (None, None))
        if last is None or us - last > s.session_timeout_sec * 1_000_000:
            start = us
        sessions[host] = (start, us)
        for kind, at, end in windows_of(us, start, s):
            groups.setdefault((host, kind, at), []).append((us, end, *rest))
    out = {}
    for (host, kind, at), found in groups.items():
        times = [f[0] for f in found]
        end = found[0][1] if found[0][1] is not None else times[-1]
        gaps = [(b - a) / 1e6 for a, b in zip(times, times[1:])]
        mean = sum(gaps) / len(gaps) if gaps else 0.0
        std = sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) if gaps else 0.0
        length = max((end - at) / 1e6, 1e-6)
        size = sum(f[4] for f in found)
        tcp, udp = (sum(f[5] == p for f in found) for p in (6, 17))
        out[(host, kind, at)] = (
            end, len(found), size, len(found) / length, size * 8 / length, len({f[2] for f in found}),
            len({f[3] for f in found}), tcp, udp, len(found) - tcp - udp, mean, std)
    return out


def as_map(profiles):
    us = [F.unix_micros(c).alias(c) for c in ("window_start", "window_end")]
    rows = profiles.select("host_id", "window_type", *us, *schemas.PROFILES.names[4:]).collect()
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows}


def same(a, b):
    """Equal keys, and values equal up to rounding of doubles."""
    assert a.keys() == b.keys()
    for key in a:
        for x, y in zip(a[key], b[key]):
            assert abs(x - y) <= 1e-6 * max(1.0, abs(x)), (key, a[key], b[key])
