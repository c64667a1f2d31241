import json
import random

import pytest
from helpers import profile, when
from pyspark.sql import functions as F

from packetlens import schemas
from packetlens.functions import scalars
from packetlens.operators.alerts import combined_risk
from packetlens.operators.rules import rule_alerts
from packetlens.operators.zscore import advance, zscore_alerts, zscores
from packetlens.settings import Thresholds


def only(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


@pytest.mark.parametrize("changes, thresholds, detector, category, risk, severity", [
    ({"uniq_dst_port": 150}, {"uniq_dst_port_scan": 100}, "rule:port_scan", "scan", 0.5, 2),
    ({"uniq_dst_ip": 200}, {"uniq_dst_ip_scan": 100}, "rule:host_scan", "scan", 0.6667, 3),
    ({"pps": 5000.0}, {"pps": 1000.0}, "rule:volume", "dos", 1.0, 3),
    ({"window_type": "session", "packets": 10, "conn_interval_avg": 60.0, "conn_interval_std": 0.1},
     {"beacon_std_max": 0.5, "beacon_min_conns": 5}, "rule:beaconing", "c2", 0.9, 4),
])
def test_rules(spark, changes, thresholds, detector, category, risk, severity):
    row = only(rule_alerts(profile(spark, **changes), Thresholds(**thresholds)))
    assert (row.detector, row.category, row.risk_score, row.severity) == (detector, category, risk, severity)


def test_beaconing_needs_a_session(spark):
    assert rule_alerts(profile(spark, packets=10, conn_interval_avg=60.0, conn_interval_std=0.1)).isEmpty()


def test_normal_traffic_is_quiet(spark):
    assert rule_alerts(profile(spark)).isEmpty()


def test_details_are_json(spark):
    row = only(rule_alerts(profile(spark, pps=5000.0), Thresholds(pps=1000.0)))
    assert json.loads(row.details) == {"pps": 5000.0, "bps": 1000.0, "pps_thr": 1000.0, "bps_thr": 1e8}
    assert row.alert_id == "1d5ca1529a877c80fe4f5729338d2cc0f56ca0de"


def test_ewma_steps():
    state, z = advance(None, [1.0], 0.2)
    assert (state, z) == ([1.0, 0.0], [0.0])
    state, z = advance(state, [2.0], 0.2)
    assert z == [0.0]
    state, z = advance(state, [4.0], 0.2)
    assert z[0] == pytest.approx(7.0) and state == pytest.approx([1.76, 1.3824])


def test_zscores_keep_hosts_apart(spark):
    rows = [
        (h, when(60 * i), when(60 * i + 60), "tumbling", *[0] * 2, v, 0.0, 1, 1, 0, 0, 0, 0.0, 0.0)
        for h in ("a", "b") for i, v in enumerate([1.0, 2.0, 4.0])]
    table = spark.createDataFrame(rows, schemas.PROFILES)
    got = sorted((r.host_id, round(r.z_pps, 6)) for r in zscores(table).collect())
    assert got == [("a", 0.0), ("a", 0.0), ("a", 7.0), ("b", 0.0), ("b", 0.0), ("b", 7.0)]
    found = zscore_alerts(table).collect()
    assert {(r.detector, r.risk_score, r.severity) for r in found} == {("ml:zscore", 0.875, 3)}
    assert json.loads(found[0].details) == {"z_scores": {"pps": 7.0}, "threshold": 4.0}


def long_history(spark, hosts, n):
    """Profiles of hosts over weeks: steps, constant stretches and outliers, with equal window ends."""
    rows = []
    for h in range(hosts):
        rng = random.Random(h)
        for i in range(n):
            kind = ("tumbling", "sliding", "session")[i % 3]
            v = 1e8 if (i // 40) % 2 else rng.uniform(0, 10) + 50 * (rng.random() < 0.05)
            rows.append((f"h{h}" if h else None, when(3600 * (i // 3) - 60 * (i % 3)), when(3600 * (i // 3) + 3600), kind, 1, 1, v, v * 8, i % 7, 3,
                         0, 0, 0, 0.0, 0.0))
    return spark.createDataFrame(rows, schemas.PROFILES)


@pytest.mark.parametrize("stretch_sec", [3600, 86_400, 10 ** 9])
def test_zscores_of_stretches_are_those_of_one_fold(spark, stretch_sec):
    table = long_history(spark, 3, 400).repartition(5)
    order = {"tumbling": 1, "sliding": 2, "session": 3}
    expected = {}
    for host in {r.host_id for r in table.collect()}:
        state = None
        for r in sorted((r for r in table.collect() if r.host_id == host), key=lambda r: (r.window_end, order[r.window_type], r.window_start)):
            state, z = advance(state, [r.pps, r.bps, float(r.uniq_dst_ip), float(r.uniq_dst_port)], 0.2)
            expected[host, r.window_type, r.window_end] = z
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # runs go on from batch to batch
    try:
        rows = zscores(table, stretch_sec=stretch_sec).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(expected) == 1200
    for r in rows:
        assert [r.z_pps, r.z_bps, r.z_uniq_dst_ip, r.z_uniq_dst_port] == pytest.approx(
            expected[r.host_id, r.window_type, r.window_end], rel=1e-6, abs=1e-6)
    assert zscores(table.limit(0)).count() == 0


def test_no_task_folds_a_whole_host(spark):
    """One host: its profiles are spread over tasks, and only one row for each stretch meets in one group."""
    table = long_history(spark, 2, 1200).where("host_id is not null")
    spread = zscores(table).groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in spread.collect()]
        plan = zscores(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and max(sizes) < 1200
    assert "hashpartitioning(host_id" in plan and "stretch" in plan


def test_combined_risk(spark):
    def alerts(*found):
        rows = [("x", f"h{i}", when(0), when(60), "tumbling", d, "c", 2, r, "", "{}") for i, d, r in found]
        return spark.createDataFrame(rows, schemas.ALERTS)

    table = alerts((1, "rule:a", 0.5), (1, "rule:b", 0.9), (1, "ml:x", 0.7), (2, "rule:a", 0.9), (3, "nn:mlp", 0.4), (4, "other", 1.0))
    got = {r.host_id: r.combined_risk for r in combined_risk(table).collect()}
    assert got == {"h1": 0.82, "h2": 0.9, "h3": 0.4, "h4": 0.0}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.severity_label(F.lit(3)), scalars.severity_label(F.lit(9)), scalars.severity_code(F.lit("critical")),
        scalars.window_type_name(F.lit(2)), scalars.window_type_name(F.lit(8)), scalars.window_type_code(F.lit("hourly")),
        scalars.timestamp_text(F.timestamp_micros(F.lit(1_500_000))),
        scalars.timestamp_text(scalars.to_millis(F.timestamp_micros(F.lit(1_234_567)))),
        scalars.event_time(F.lit(1_999_999_999)),
        scalars.alert_id(F.lit("h"), F.timestamp_micros(F.lit(-1_500_000)), F.lit("d")) == F.sha1(F.lit("h|-1|d")),
    ).first()
    assert tuple(row) == (
        "high", None, 4, "sliding", "tumbling", None, "1970-01-01 00:00:01.500000", "1970-01-01 00:00:01.234000",
        when(1.999999), True)


def test_feature_columns(spark):
    row = profile(spark).select(scalars.feature_vector().alias("v"), scalars.feature_map().alias("m")).first()
    assert row.v == [10.0, 1000.0, 1.0, 1000.0, 1.0, 1.0, 10.0, 0.0, 0.0, 0.0, 0.0]
    assert row.m == dict(zip(schemas.FEATURES, row.v))
