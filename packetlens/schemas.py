"""Fixed schemas of every table and message."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: names, codes and field order of the message formats -------------------------
HOOK_NAMES = {0: "HOOK_TC", 1: "HOOK_XDP", 2: "HOOK_CGROUP_SKB"}
DIRECTION_NAMES = {0: "INGRESS", 1: "EGRESS"}
WINDOW_TYPES = {1: "tumbling", 2: "sliding", 3: "session"}
SEVERITIES = {1: "low", 2: "medium", 3: "high", 4: "critical"}
FEATURES = [
    "packets", "bytes", "pps", "bps", "uniq_dst_ip", "uniq_dst_port",
    "proto_tcp", "proto_udp", "proto_other", "conn_interval_avg", "conn_interval_std",
]
PROFILE_TTL_DAYS = 30
ALERT_TTL_DAYS = 90
# -------------------------------------------------------------------------------------------------

LOW, MEDIUM, HIGH, CRITICAL = SEVERITIES


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()

PACKET_EVENT = _struct(
    ("timestamp_ns", _L), ("src_ip", _L), ("dst_ip", _L), ("src_port", _I), ("dst_port", _I),
    ("pkt_len", _L), ("protocol", _I), ("hook", _S), ("direction", _S), ("ifindex", _L),
)
PACKET_BATCH = _struct(("host_id", _S), ("batch_ts", _L), ("events", T.ArrayType(PACKET_EVENT)))
HOST_INFO = _struct(
    ("host_id", _S), ("hostname", _S), ("os", _S), ("arch", _S), ("kernel_version", _S),
    ("interfaces", T.MapType(_L, _S)), ("boot_time_sec", _L), ("register_ts", _L),
)
PACKETS = _struct(
    ("host_id", _S), ("ts", _TS), ("dst_ip", _L), ("dst_port", _I), ("pkt_len", _L), ("protocol", _I),
)
PROFILES = _struct(
    ("host_id", _S), ("window_start", _TS), ("window_end", _TS), ("window_type", _S),
    ("packets", _L), ("bytes", _L), ("pps", _D), ("bps", _D), ("uniq_dst_ip", _L), ("uniq_dst_port", _L),
    ("proto_tcp", _L), ("proto_udp", _L), ("proto_other", _L),
    ("conn_interval_avg", _D), ("conn_interval_std", _D),
)
ALERTS = _struct(
    ("alert_id", _S), ("host_id", _S), ("window_start", _TS), ("window_end", _TS), ("window_type", _S),
    ("detector", _S), ("category", _S), ("severity", _I), ("risk_score", _D), ("model_version", _S),
    ("details", _S),
)
ALERT_ROWS = _struct(
    ("alert_id", _S), ("host_id", _S), ("detected_at", _TS), ("window_start", _TS), ("detector", _S),
    ("category", _S), ("severity", _I), ("risk_score", _D), ("model_version", _S), ("details", _S),
)
PROFILE_KEY = ["host_id", "window_type", "window_start"]
ALERT_KEY = ["host_id", "detected_at", "detector"]
