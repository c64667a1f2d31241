import os
import tempfile

import pytest
from helpers import accumulate, as_map, packets, same, when
from pyspark.sql import functions as F
from test_windows import traffic

from packetlens import schemas
from packetlens.operators import registry
from packetlens.operators import windows as W
from packetlens.operators.alerts import HIT
from packetlens.operators.zscore import advance
from packetlens.plans import store, workspace
from packetlens.settings import Thresholds, WindowSettings
from packetlens.streaming import live, runs, sessions
from packetlens.streaming import windows as SW

LATE = [[10, 20], [120], [30, 70, 119.5], [150], [400], [405], [25, 410]]


def stream(spark, batches):
    """A packet stream that reads one of ``batches`` per micro-batch."""
    folder = tempfile.mkdtemp(prefix="packets-")
    for i, rows in enumerate(batches):
        feed(spark, folder, i, rows)
    return folder, source(spark, folder)


def feed(spark, folder, i, rows):
    df = packets(spark, [("h1", r) if not isinstance(r, tuple) else r for r in rows]).toPandas()
    path = f"{folder}/{i:04}.parquet"
    df["ts"] = df["ts"].dt.tz_localize("UTC")
    df.to_parquet(path, index=False, coerce_timestamps="us")
    os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def source(spark, folder):
    schema = "host_id string, dst_ip long, dst_port int, pkt_len int, protocol int, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_packets(spark):
    """Judged by the watermark of the batch before; closed windows are dropped and counted."""
    folder, df = stream(spark, LATE)
    path = workspace.fresh(spark, "late")
    query = runs.to_table(SW.fixed_profiles(df, "tumbling"), path, f"{path}.checkpoint", available_now=True)
    query.awaitTermination()
    found = {(r.window_start, r.packets) for r in spark.read.parquet(path).collect()}
    assert found == {(when(0), 3), (when(60), 2), (when(120), 2)}
    dropped = [op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]]
    assert sum(dropped) == 3  # one late packet: its address, its port and its slice


def test_late_packets_emitted_again_on_request(spark):
    folder, df = stream(spark, LATE)
    base, found = workspace.fresh(spark, "again"), []
    sink = lambda rows, batch: found.extend((r.window_type, r.window_start, r.packets) for r in rows.collect())
    live.reemit_late(df, sink, f"{base}/marks", f"{base}/checkpoint", available_now=True).awaitTermination()
    # 30 comes after 120 - 30 has passed [0, 60); 25 comes after every window that holds it
    assert ("tumbling", when(0), 1) in found and found.count(("tumbling", when(0), 1)) == 2
    assert ("sliding", when(0), 1) in found


def test_closed_at_equality(spark):
    _, df = stream(spark, [[10], [90]])
    assert runs.run_available(SW.fixed_profiles(df, "tumbling"), "equal").count() == 1


@pytest.mark.parametrize("seed, settings", [
    (11, WindowSettings()), (12, WindowSettings(tumbling_sec=90, sliding_sec=150, session_timeout_sec=7, slice_sec=3))])
def test_stream_equals_batch(spark, seed, settings):
    """In-order packets in many micro-batches, with a restart in the middle."""
    rows = [(h, us / 1e6, *rest) for h, us, *rest in sorted(traffic(seed, 300), key=lambda r: r[1])]
    folder = tempfile.mkdtemp(prefix="packets-")
    base = workspace.fresh(spark, "equal")
    for part in range(4):
        feed(spark, folder, part, rows[part * 75:part * 75 + 75])
        if part % 2:  # the second run goes on from the checkpoint of the first
            query = live.live(source(spark, folder), [registry.detector("rule", thresholds=Thresholds(uniq_dst_port_scan=5))],
                              live.table_sinks(f"{base}/profiles", f"{base}/alerts"), f"{base}/checkpoint", settings, 3,
                              available_now=True)
            query.awaitTermination()
    top = max(round(r[1] * 1e6) for r in rows) // 1000 * 1000 - settings.watermark_sec * 1_000_000
    expected = {
        key: value for key, value in accumulate([(r[0], round(r[1] * 1e6), *r[2:]) for r in rows], settings).items()
        if (top - value[0] > settings.session_timeout_sec * 1_000_000 if key[1] == "session" else value[0] <= top)}
    table = spark.read.parquet(f"{base}/profiles")
    assert table.count() == len(expected)  # every window once
    same(as_map(store.latest(table, schemas.PROFILE_KEY)), expected)
    alerts = spark.read.parquet(f"{base}/alerts")
    assert alerts.where("detector = 'rule:port_scan'").count() == sum(v[6] >= 5 for v in expected.values())


def test_stateful_zscores_across_batches(spark):
    path, base = workspace.fresh(spark, "profiles"), workspace.fresh(spark, "zscores")
    schemas_row = lambda i, v: [("a", when(60 * i), when(60 * i + 60), "tumbling", 1, 1, v, 0.0, 1, 1, 0, 0, 0, 0.0, 0.0)]
    found = []
    for i, v in enumerate([1.0, 2.0, 4.0]):
        spark.createDataFrame(schemas_row(i, v), schemas.PROFILES).coalesce(1).write.mode("append").parquet(path)
        live.live_zscores(spark, path, lambda df, _: found.extend(df.collect()), base, available_now=True).awaitTermination()
    assert [(r.window_start, r.risk_score) for r in found] == [(when(120), 0.875)]


def test_live_refuses_two_states_of_zscores():
    with pytest.raises(ValueError):
        live.live(None, [registry.detector("zscore"), registry.detector("zscore", alpha=0.5)], (None, None), "")


def test_live_late_packets(spark):
    """What comes behind the watermark is counted, joins open windows and makes closed ones appear again."""
    base, late = workspace.fresh(spark, "live_late"), []
    folder, df = stream(spark, LATE)
    live.live(df, [registry.detector("rule", thresholds=Thresholds())], live.table_sinks(f"{base}/profiles", f"{base}/alerts"), f"{base}/checkpoint",
              WindowSettings(), 2, available_now=True, on_late=lambda rows, _: late.extend(r.packets for r in rows.collect())).awaitTermination()
    rows = spark.read.parquet(f"{base}/profiles").where("window_type = 'tumbling'").collect()
    # watermarks by batch: none, none, 90, 90, 120, 370, 375; 30 comes in the batch that closes [0, 60), 25 after it
    assert sorted((r.window_start, r.packets) for r in rows) == [(when(0), 1), (when(0), 3), (when(60), 2), (when(120), 2)]
    assert sum(late) == 3  # 30 and 70 behind 90, 25 behind 375
    newest = store.latest(spark.read.parquet(f"{base}/profiles"), schemas.PROFILE_KEY).where("window_type = 'tumbling' and window_start < timestamp'1970-01-01 00:01:00'")
    assert [r.packets for r in newest.collect()] == [1]


def test_kafka_source_is_declared(spark):
    from packetlens.sources.packets import read_packets

    with pytest.raises(Exception, match="(?i)kafka"):  # the connector is not on this classpath
        read_packets(spark)


class Failing(registry.Detector):
    """Cannot score anything, and shows it only while it runs."""

    name = "failing"
    needs_model = False

    def _scored(self, profiles):
        return profiles.withColumn("broken", F.raise_error(F.concat(F.lit("no score for "), "host_id")))

    def _hits(self):
        return [F.when(F.col("broken").isNotNull(), F.lit(None).cast(HIT))]


def test_a_failing_detector_does_not_stop_the_others(spark):
    _, df = stream(spark, [[10, 11, 12], [200], [400]])
    base = workspace.fresh(spark, "failing")
    rules = registry.detector("rule", thresholds=Thresholds(uniq_dst_port_scan=1))
    live.live(df, [rules, Failing()], live.table_sinks(f"{base}/profiles", f"{base}/alerts"), f"{base}/checkpoint",
              available_now=True).awaitTermination()
    alone = workspace.fresh(spark, "alone")
    _, df = stream(spark, [[10, 11, 12], [200], [400]])
    live.live(df, [rules], live.table_sinks(f"{alone}/profiles", f"{alone}/alerts"), f"{alone}/checkpoint",
              available_now=True).awaitTermination()
    found, want = (sorted(r.alert_id for r in spark.read.parquet(f"{p}/alerts").collect()) for p in (base, alone))
    assert found == want and found


def profile_rows(spark, values, start=0):
    rows = [("a", when(60 * i), when(60 * i + 60), "tumbling", 1, 1, v, 0.0, 1, 1, 0, 0, 0, 0.0, 0.0) for i, v in enumerate(values, start)]
    return spark.createDataFrame(rows, schemas.PROFILES)


def test_a_repeated_batch_replaces_itself(spark):
    path = workspace.fresh(spark, "repeated")
    for batch in (0, 1, 1, 0):
        store.load_profiles(profile_rows(spark, [1.0, 2.0], 2 * batch), path, batch)
    assert sorted(r.window_start for r in spark.read.parquet(path).collect()) == [when(60 * i) for i in range(4)]


@pytest.mark.parametrize("together", [True, False])
def test_zscores_skip_profiles_that_were_folded(spark, together):
    """Copies and late parts change nothing, in the same micro-batch or a later one."""
    values = [1.0, 2.0, 4.0, 8.0, 40.0]
    path, base = workspace.fresh(spark, "profiles"), workspace.fresh(spark, "zscores")
    found = []
    run = lambda: live.live_zscores(spark, path, lambda df, _: found.extend(df.collect()), base, 1.0, available_now=True).awaitTermination()
    for part in range(2):
        profile_rows(spark, values).coalesce(1).write.mode("append").parquet(path)
        if not together:
            run()
    profile_rows(spark, [0.5], 1).coalesce(1).write.mode("append").parquet(path)
    run()
    state, want = None, []
    for i, v in enumerate(values):
        state, z = advance(state, [v, 0.0, 1.0, 1.0], 0.2)
        if abs(z[0]) >= 1.0:
            want.append((when(60 * i), round(min(1.0, abs(z[0]) / 2), 4)))
    assert sorted((r.window_start, r.risk_score) for r in found) == want and want


def test_settings_are_put_back(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass", "spark.sql.session.timeZone")
    before = {k: spark.conf.get(k, None) for k in names}
    _, df = stream(spark, [[10], [200]])
    runs.run_available(SW.fixed_profiles(df, "tumbling"), "kept", 2).count()
    assert {k: spark.conf.get(k, None) for k in names} == before
