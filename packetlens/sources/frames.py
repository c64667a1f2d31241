"""Raw captured bytes to packet columns, with byte expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, direction_name, hook_name

# ---- fixed values: header layout ----------------------------------------------------------------
ETHERNET_HEADER, IPV4_HEADER, TCP_HEADER, UDP_HEADER = 14, 20, 20, 8
ETHERTYPE_IPV4 = 0x0800
TCP, UDP = 6, 17
RECORD_LENGTH = 32
RECORD_FIELDS = [  # name, offset, bytes (little-endian)
    ("ktime_ns", 0, 8), ("src_ip", 8, 4), ("dst_ip", 12, 4), ("src_port", 16, 2), ("dst_port", 18, 2),
    ("pkt_len", 20, 4), ("protocol", 24, 1), ("hook", 25, 1), ("direction", 26, 1), ("pad", 27, 1), ("ifindex", 28, 4),
]
# -------------------------------------------------------------------------------------------------


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).try_cast("long")


def big_endian(data: Column, offset: Column | int, size: int) -> Column:
    start = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    return _number(F.hex(F.substring(data, start, F.lit(size))))


def little_endian(data: Column, offset: int, size: int) -> Column:
    return _number(F.concat(*[F.hex(F.substring(data, offset + i, 1)) for i in range(size, 0, -1)]))


def decode_frames(df: DataFrame, frame: Column | str = "frame", link: str = "ethernet") -> DataFrame:
    """Add address, port, length and protocol columns to IPv4 frames; all other frames are dropped.

    ``link`` is ``ethernet`` (14-byte header first, EtherType checked) or ``ip`` (version checked).
    Ports are 0 unless a whole TCP or UDP header is there. Addresses keep the network byte order in
    memory, so the first octet is the low byte.
    """
    data = col(frame)
    if link == "ethernet":
        base, size = ETHERNET_HEADER, F.length(data)
        is_ipv4 = (size >= ETHERNET_HEADER + IPV4_HEADER) & (big_endian(data, 12, 2) == ETHERTYPE_IPV4)
    elif link == "ip":
        base, size = 0, F.length(data)
        is_ipv4 = (size >= IPV4_HEADER) & (F.shiftright(big_endian(data, 0, 1), 4) == 4)
    else:
        raise ValueError(f"unknown link type: {link!r}")
    rows = df.where(is_ipv4).withColumns({
        "src_ip": little_endian(data, base + 12, 4),
        "dst_ip": little_endian(data, base + 16, 4),
        "protocol": big_endian(data, base + 9, 1).cast("int"),
        "pkt_len": big_endian(data, base + 2, 2),
        "_l4": (F.lit(base) + big_endian(data, base, 1).bitwiseAND(15) * 4).cast("int"),
    })
    l4, rest = F.col("_l4"), size - F.col("_l4")
    has_ports = (((F.col("protocol") == TCP) & (rest >= TCP_HEADER))
                 | ((F.col("protocol") == UDP) & (rest >= UDP_HEADER)))
    return rows.withColumns({
        "src_port": F.when(has_ports, big_endian(data, l4, 2)).otherwise(0).cast("int"),
        "dst_port": F.when(has_ports, big_endian(data, l4 + 2, 2)).otherwise(0).cast("int"),
    }).drop("_l4")


def decode_records(df: DataFrame, record: Column | str = "record") -> DataFrame:
    """Fixed 32-byte capture records to columns; shorter ones are dropped and counted in an observation."""
    data = col(record)
    whole = F.length(data) >= RECORD_LENGTH
    counted = df.observe("capture_records", F.count(F.lit(1)).alias("read"),
                         F.count_if(F.coalesce(~whole, F.lit(True))).alias("broken"))
    rows = counted.where(whole).withColumns({name: little_endian(data, at, size) for name, at, size in RECORD_FIELDS})
    ints = ["src_port", "dst_port", "protocol"]
    return rows.withColumns({
        **{name: F.col(name).cast("int") for name in ints},
        "hook": hook_name("hook"), "direction": direction_name("direction"),
    }).drop("pad")


def to_wallclock(df: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Add ``timestamp_ns`` = ``ktime_ns`` + the host's ``offset_ns``.

    The offset is a column of ``df``, or of ``hosts`` (one row per host). The join is left to the
    optimizer: it broadcasts ``hosts`` only below its size limit and splits a busy host otherwise.
    """
    if hosts is not None:
        df = df.join(hosts.select("host_id", "offset_ns"), "host_id")
    return df.withColumn("timestamp_ns", F.col("ktime_ns") + F.col("offset_ns"))
