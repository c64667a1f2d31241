from datetime import datetime

import pytest
from helpers import when
from pyspark.sql import functions as F

from packetlens import schemas
from packetlens.operators.filters import capture_scope
from packetlens.sources import frames, packets, rows, wire


def event(ts, **changes):
    base = dict(timestamp_ns=ts, src_ip=2**32 - 1, dst_ip=1, src_port=5, dst_port=80, pkt_len=100, protocol=6,
                hook="HOOK_XDP", direction="EGRESS", ifindex=3)
    return {**base, **changes}


def batches(spark, *found):
    return spark.createDataFrame([dict(host_id=h, batch_ts=t, events=e) for h, t, e in found], schemas.PACKET_BATCH)


def test_batch_round_trip_skips_broken_and_empty(spark):
    sent = batches(spark, ("h1", 7, [event(1_999), event(2_000, hook="HOOK_TC")]), ("h2", 8, []))
    messages = packets.encode_batches(sent)
    assert messages.count() == 1
    broken = spark.createDataFrame([("x", b"\xff\xff\xff")], "key string, value binary")
    decoded = packets.decode_batches(messages.unionByName(broken))
    assert decoded.collect() == sent.where("host_id = 'h1'").collect()
    flat = packets.analyzer_columns(packets.explode_events(decoded))
    assert [(r.host_id, r.ts) for r in flat.collect()] == [("h1", when(1e-6)), ("h1", when(2e-6))]


def test_wire_bytes_are_protobuf():
    cls = wire.message_class("PacketBatch")
    message = cls(host_id="h", batch_ts=1)
    message.events.add(timestamp_ns=1, src_ip=2, hook=2)
    # field numbers and wire types: host_id 1 (text), batch_ts 2 (varint), events 3 (message, fixed32 address)
    assert message.SerializeToString() == b"\x0a\x01h\x10\x01\x1a\x09\x08\x01\x15\x02\x00\x00\x00\x40\x02"


def test_hosts_round_trip(spark):
    host = dict(host_id="h", hostname="n", os="linux", arch="arm", kernel_version="6", interfaces={1: "lo", 2: "eth0"},
                boot_time_sec=5, register_ts=6)
    sent = spark.createDataFrame([host], schemas.HOST_INFO)
    assert packets.decode_hosts(packets.encode_hosts(sent)).collect() == sent.collect()


def test_pack_batches(spark):
    second = 1_000_000_000
    events = spark.createDataFrame(
        [("h1", *event(t).values()) for t in [*range(5), second, second + 1]] + [("h2", *event(3).values())],
        "host_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PACKET_EVENT))
    packed = packets.pack_batches(events, size=2)
    got = sorted((r.host_id, r.batch_ts, [e.timestamp_ns for e in r.events]) for r in packed.collect())
    assert got == [("h1", 1, [0, 1]), ("h1", 3, [2, 3]), ("h1", 4, [4]), ("h1", second + 1, [second, second + 1]), ("h2", 3, [3])]
    assert packets.explode_events(packed).exceptAll(events).isEmpty()


IP = "0A000001", "C0A80102"  # 10.0.0.1 -> 192.168.1.2
SRC, DST = 0x0100000A, 0x0201A8C0


def ipv4(protocol, l4, first="45", options=""):
    return f"{first}000054{'0' * 8}40{protocol:02X}0000{IP[0]}{IP[1]}{options}{l4}"


TCP = "04D20050" + "0" * 32
UDP = "04D20035" + "0" * 8


@pytest.mark.parametrize("name, packet, expected", [
    ("tcp", ipv4(6, TCP), (6, 1234, 80)),
    ("udp", ipv4(17, UDP), (17, 1234, 53)),
    ("icmp", ipv4(1, "0800" + "0" * 12), (1, 0, 0)),
    ("options", ipv4(6, TCP, "46", "01010101"), (6, 1234, 80)),
    ("tcp cut short", ipv4(6, TCP[:-2]), (6, 0, 0)),
    ("udp cut short", ipv4(17, UDP[:-2]), (17, 0, 0)),
    ("version 6", ipv4(6, TCP, "65"), None),
    ("header cut short", ipv4(6, "")[:-2], None),
])
def test_frames(spark, name, packet, expected):
    fields = ["src_ip", "dst_ip", "pkt_len", "protocol", "src_port", "dst_port"]
    want = [] if expected is None else [(SRC, DST, 0x54, *expected)]
    bare = spark.createDataFrame([(bytes.fromhex(packet),)], "frame binary")
    assert [tuple(r) for r in frames.decode_frames(bare, link="ip").select(*fields).collect()] == want
    if name != "version 6":  # behind an Ethernet header the EtherType decides
        full = spark.createDataFrame([(bytes(12) + b"\x08\x00" + bytes.fromhex(packet),)], "frame binary")
        assert [tuple(r) for r in frames.decode_frames(full).select(*fields).collect()] == want
    other = spark.createDataFrame([(bytes(12) + b"\x86\xdd" + bytes.fromhex(packet),)], "frame binary")
    assert frames.decode_frames(other).isEmpty()


def test_records(spark):
    import struct

    data = struct.pack("<QIIHHIBBBBI", 123456789012, SRC, DST, 1, 2, 1500, 17, 2, 1, 0, 9)
    table = spark.createDataFrame([("h", data), ("h", data[:31]), ("h", None)], "host_id string, record binary")
    found = frames.decode_records(table).drop("record").collect()
    assert [tuple(r) for r in found] == [
        ("h", 123456789012, SRC, DST, 1, 2, 1500, 17, "HOOK_CGROUP_SKB", "EGRESS", 9)]
    hosts = spark.createDataFrame([("h", 1000)], "host_id string, offset_ns long")
    assert frames.to_wallclock(frames.decode_records(table), hosts).first().timestamp_ns == 123456790012


def test_capture_scope(spark):
    table = spark.createDataFrame(
        [(h, d, i) for h in schemas.HOOK_NAMES.values() for d in schemas.DIRECTION_NAMES.values() for i in (1, 2)],
        "hook string, direction string, ifindex long")

    def kept(*args):
        return sorted(tuple(r) for r in capture_scope(table, *args).collect())

    assert kept("interface", "ingress", [1]) == [("HOOK_XDP", "INGRESS", 1)]
    assert kept("interface", "egress", [1, 2]) == [("HOOK_TC", "EGRESS", 1), ("HOOK_TC", "EGRESS", 2)]
    assert len(kept("interface", "both")) == 4 and len(kept("cgroup", "both")) == 4
    assert kept("cgroup", "ingress") == [("HOOK_CGROUP_SKB", "INGRESS", 1), ("HOOK_CGROUP_SKB", "INGRESS", 2)]
    with pytest.raises(ValueError):
        capture_scope(table, "tunnel")
    with pytest.raises(ValueError):
        capture_scope(table, "cgroup", "sideways")


def test_rows_quarantine(spark):
    good = ('{"host_id":"h","window_start":"2024-01-01 00:00:00.123456","window_end":"2024-01-01 00:01:00.000000",'
            '"window_type":"tumbling","packets":3,"pps":0.5}')
    texts = [good, "not json", good.replace("tumbling", "hourly"), good.replace('"host_id":"h",', ""), good.replace("3", '"x"')]
    ok, bad = rows.parse_rows(spark.createDataFrame([(t,) for t in texts], "value string"), schemas.PROFILES)
    row = ok.collect()
    assert len(row) == 1 and row[0].window_start == datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert (row[0].packets, row[0].pps, row[0].bytes) == (3, 0.5, 0)
    assert sorted(r.error for r in bad.collect()) == [
        "missing key", "not a message of this schema", "not a message of this schema", "unknown window type"]
    alert = ('{"alert_id":"a","host_id":"h","detected_at":"2024-01-01 00:00:00.000000",'
             '"window_start":"2024-01-01 00:00:00.000000","detector":"d","category":"c","severity":9,"risk_score":1}')
    ok, bad = rows.parse_rows(spark.createDataFrame([(alert,), (alert.replace("9", "4"),)], "value string"), schemas.ALERT_ROWS)
    assert [r.severity for r in ok.collect()] == [4] and [r.error for r in bad.collect()] == ["unknown severity"]


def test_profiles_survive_json(spark):
    from helpers import profile

    table = profile(spark, pps=0.1, window_start=when(0.25))
    ok, bad = rows.parse_rows(rows.profiles_as_json(table), schemas.PROFILES)
    assert ok.collect() == table.collect() and bad.isEmpty()
    assert rows.profiles_as_json(table).select(F.col("key")).first().key == "h1"
