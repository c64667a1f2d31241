"""Tables derived from the ``events`` and ``supplier`` test tables, and the settings used over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .settings import Thresholds, WindowSettings

WINDOWS = WindowSettings(
    tumbling_sec=21600, sliding_sec=86400, sliding_step_sec=21600, session_timeout_sec=1800,
    watermark_sec=3600, slice_sec=600, state_slice_sec=600,
)
THRESHOLDS = Thresholds(
    pps=0.0007, bps=100_000_000.0, uniq_dst_port_scan=15, uniq_dst_ip_scan=11,
    beacon_std_max=320.0, beacon_min_conns=5,
)


def packets_from(events: DataFrame) -> DataFrame:
    """The packets view on (batch or streaming) ``events`` rows."""
    return events.select(
        F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("host_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("user_id") * F.lit(2654435761)) % F.lit(4294967296)).alias("dst_ip"),
        F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        (F.lit(40) + F.floor("value")).cast("int").alias("pkt_len"),
        F.when(F.col("event_type").isin("click", "view"), 6)
        .when(F.col("event_type").isin("purchase", "signup"), 17).otherwise(1).alias("protocol"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def load_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(load_events(spark, sf_dir))


def capture_events(packets: DataFrame) -> DataFrame:
    """Full packet events: the packets view with a source, a hook, a direction and an interface."""
    return packets.select(
        "host_id", "event_id", (F.unix_micros("ts") * 1000 + F.col("event_id") % 1000).alias("timestamp_ns"),
        ((F.col("event_id") * F.lit(40503)) % F.lit(4294967296)).alias("src_ip"), "dst_ip",
        (F.lit(1024) + F.col("event_id") % 50000).cast("int").alias("src_port"), "dst_port",
        F.col("pkt_len").cast("long").alias("pkt_len"), "protocol",
        F.when(F.col("protocol") == 6, "HOOK_TC").when(F.col("protocol") == 17, "HOOK_XDP")
        .otherwise("HOOK_CGROUP_SKB").alias("hook"),
        F.when(F.col("dst_port") < 50, "INGRESS").otherwise("EGRESS").alias("direction"),
        (F.lit(1) + F.col("dst_port") % 3).cast("long").alias("ifindex"),
    )


def _hex(value: Column | str, size: int) -> Column:
    return F.lpad(F.hex(F.col(value) if isinstance(value, str) else value), 2 * size, "0")


def _hex_le(value: Column | str, size: int) -> Column:
    text = _hex(value, size)
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])


def frames_from(packets: DataFrame, link: str) -> DataFrame:
    """Every packet as raw bytes, once as IPv4 and once as another protocol that has to be dropped.

    TCP frames to ports of 50 and above carry four bytes of IP options; UDP frames to ports below 20
    are cut short inside the UDP header.
    """
    e = capture_events(packets).withColumn("version", F.explode(F.array(F.lit(4), F.lit(6))))
    options = (F.col("protocol") == 6) & (F.col("dst_port") >= 50)
    first = F.when(options, F.lit("6")).otherwise(F.lit("5"))
    ip = F.concat(
        F.col("version").cast("string"), first, F.lit("00"), _hex("pkt_len", 2), F.lit("0" * 8), F.lit("40"),
        _hex("protocol", 1), F.lit("0000"), _hex_le("src_ip", 4), _hex_le("dst_ip", 4),
        F.when(options, F.lit("01010101")).otherwise(F.lit("")))
    ports = F.concat(_hex("src_port", 2), _hex("dst_port", 2))
    l4 = (F.when(F.col("protocol") == 6, F.concat(ports, F.lit("0" * 32)))
          .when((F.col("protocol") == 17) & (F.col("dst_port") < 20), ports)
          .when(F.col("protocol") == 17, F.concat(ports, F.lit("0" * 8)))
          .otherwise(F.lit("0800" + "0" * 12)))
    kind = F.when(F.col("version") == 4, F.lit("0800")).otherwise(F.lit("86DD"))
    head = F.concat(F.lit("0" * 24), kind) if link == "ethernet" else F.lit("")
    return e.select(
        "host_id", "event_id", F.col("timestamp_ns").alias("ktime_ns"), F.unhex(F.concat(head, ip, l4)).alias("frame"))


def records_from(packets: DataFrame) -> DataFrame:
    """Every packet as a 32-byte capture record, and once more cut short."""
    e = capture_events(packets)
    hook = F.when(F.col("hook") == "HOOK_TC", 0).when(F.col("hook") == "HOOK_XDP", 1).otherwise(2)
    text = F.concat(
        _hex_le("timestamp_ns", 8), _hex_le("src_ip", 4), _hex_le("dst_ip", 4), _hex_le("src_port", 2),
        _hex_le("dst_port", 2), _hex_le("pkt_len", 4), _hex("protocol", 1), _hex(hook, 1),
        _hex(F.when(F.col("direction") == "INGRESS", 0).otherwise(1), 1), F.lit("00"), _hex_le("ifindex", 4))
    both = F.explode(F.array(F.unhex(text), F.unhex(F.substring(text, 1, 62))))
    return e.select("host_id", "event_id", both.alias("record"))


def hosts_from(supplier: DataFrame) -> DataFrame:
    """Host registrations from the ``supplier`` table."""
    key = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("h"), key.cast("string")).alias("host_id"), F.col("s_name").alias("hostname"),
        F.lit("linux").alias("os"), F.when(key % 2 == 0, "x86_64").otherwise("aarch64").alias("arch"),
        F.concat(F.lit("6.1."), F.col("s_nationkey").cast("string")).alias("kernel_version"),
        F.create_map(F.lit(1).cast("long"), F.lit("lo"), (key % 7 + 2).cast("long"), F.lit("eth0")).alias("interfaces"),
        (F.lit(1700000000) + key).cast("long").alias("boot_time_sec"),
        ((F.lit(1700000000) + key) * F.lit(1000000000)).cast("long").alias("register_ts"),
    )
