import random

import pytest
from helpers import accumulate, as_map, packets, same, seconds, when
from pyspark.sql import functions as F

from packetlens.operators import windows as W
from packetlens.operators.filters import late_events
from packetlens.settings import WindowSettings

S = WindowSettings()


def closed(df, at, timeout=120):
    return W.closed_profiles(df, F.lit(when(at)), timeout)


def test_tumbling_buckets(spark):
    found = W.tumbling_profiles(packets(spark, [("h1", 10), ("h1", 59), ("h1", 61)]), S)
    rows = closed(found, 60).collect()
    assert [(seconds(r.window_start), seconds(r.window_end), r.packets) for r in rows] == [(0, 60, 2)]


def test_tumbling_not_closed_early(spark):
    assert closed(W.tumbling_profiles(packets(spark, [("h1", 10)]), S), 30).isEmpty()


def test_session_split(spark):
    s = WindowSettings(session_timeout_sec=30)
    rows = W.session_profiles(packets(spark, [("h1", 100), ("h1", 120), ("h1", 200)]), s).orderBy("window_start").collect()
    assert [r.packets for r in rows] == [2, 1]


def test_session_expiry(spark):
    s = WindowSettings(session_timeout_sec=30)
    found = W.session_profiles(packets(spark, [("h1", 100)]), s)
    assert closed(found, 200, 30).count() == 1
    assert closed(found, 130, 30).isEmpty()


def test_all_windows_and_uniques(spark):
    s = WindowSettings(sliding_sec=120, session_timeout_sec=30, watermark_sec=10)
    rows = [("h1", 10, 1, 80, 100), ("h1", 20, 2, 443, 200), ("h1", 200, 3, 22, 50)]
    first = closed(W.profiles(packets(spark, rows), s), 190, 30).where("window_type = 'tumbling'").collect()[0]
    assert (first.uniq_dst_ip, first.uniq_dst_port) == (2, 2)


@pytest.mark.parametrize("last, expected", [(220, [(100, 220)]), (220.001, [(100, 100), (220.001, 220.001)])])
def test_session_gap_at_timeout(spark, last, expected):
    rows = W.session_profiles(packets(spark, [("h1", 100), ("h1", last)]), S).orderBy("window_start").collect()
    assert [(seconds(r.window_start), seconds(r.window_end)) for r in rows] == expected


def test_one_packet_session(spark):
    row = W.session_profiles(packets(spark, [("h1", 100)]), S).first()
    assert (row.pps, row.bps) == (1e6, 8e8)
    longer = WindowSettings(min_duration_sec=1.0)
    assert W.session_profiles(packets(spark, [("h1", 100)]), longer).first().pps == 1.0


def test_sliding_starts(spark):
    assert [seconds(r.window_start) for r in W.sliding_profiles(packets(spark, [("h1", 10)]), S).collect()] == [0]
    odd = WindowSettings(sliding_sec=150)
    rows = W.sliding_profiles(packets(spark, [("h1", 500)]), odd).orderBy("window_start").collect()
    assert [seconds(r.window_start) for r in rows] == [360, 420, 480]


def test_gaps(spark):
    rows = W.tumbling_profiles(packets(spark, [("h1", 50), ("h1", 70)]), S).collect()
    assert [(r.conn_interval_avg, r.conn_interval_std) for r in rows] == [(0, 0), (0, 0)]
    row = W.tumbling_profiles(packets(spark, [("h1", 0), ("h1", 1), ("h1", 4)]), S).first()
    assert (row.conn_interval_avg, row.conn_interval_std) == (2, 1)
    even = W.tumbling_profiles(packets(spark, [("h1", t / 10) for t in range(500)]), S).first()
    assert even.conn_interval_std == 0


def traffic(seed, n=600):
    """One host with most of the packets, two quiet ones, repeated times, far and near gaps."""
    rng = random.Random(seed)
    rows, at = [], {h: rng.randrange(0, 400_000_000) for h in ("busy", "calm", "rare")}
    for _ in range(n):
        host = rng.choices(["busy", "calm", "rare"], [8, 2, 1])[0]
        at[host] += rng.choice([0, 1, 500_000, 7_000_000, 60_000_000, 119_999_999, 120_000_000, 120_000_001, 400_000_000]
                               if host != "busy" else [0, 250_000, 900_000, 3_000_000])
        rows.append((host, at[host], rng.randrange(6), rng.randrange(30), rng.randrange(40, 1500), rng.choice([1, 6, 6, 17])))
    return rows


@pytest.mark.parametrize("seed, settings", [
    (1, S),
    (2, WindowSettings(slice_sec=1)),
    (3, WindowSettings(tumbling_sec=90, sliding_sec=150, sliding_step_sec=60, session_timeout_sec=7)),
    (4, WindowSettings(tumbling_sec=61, sliding_sec=60, sliding_step_sec=100, session_timeout_sec=1)),
])
def test_equals_direct_accumulation(spark, seed, settings):
    rows = traffic(seed)
    table = packets(spark, [(h, us / 1e6, *rest) for h, us, *rest in rows])
    same(as_map(W.profiles(table, settings)), accumulate(rows, settings))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_group_grows_with_a_busy_host(spark):
    """Raw packets are shuffled by host and slice only."""
    for df in (W.profiles(packets(spark, [("h1", 1)]), S, ("tumbling", "sliding")), W._panes(packets(spark, [("h1", 1)]), S, W.ALL_KINDS)):
        windows = [line for line in plan_of(df).splitlines() if "Window [lag(us" in line]
        assert windows and all("slice_us" in line.split("],")[-2] for line in windows)


def test_the_source_is_scanned_once_for_segments_and_once_for_values(spark, tmp_path):
    """Panes come from a table by then, and both branches of the values share one exchange."""
    packets(spark, [("h1", 1), ("h1", 5), ("h2", 9)]).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    df = W.profiles(source, S)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line and str(tmp_path) in line]
    assert len(scans) == 1, final


def test_late_events_levels(spark):
    rng = random.Random(5)
    times = [rng.randrange(0, 500) for _ in range(300)]
    table = packets(spark, [("h", t) for t in times]).withColumn("arrival", F.lit(0))
    numbered = spark.createDataFrame(list(enumerate(times)), "arrival long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert table.count() == 300
    top, expected = 0, []
    for i, t in enumerate(times):
        expected.append((i, t < top - 30))
        top = max(top, t)
    for chunk in (7, 40, 1000):
        found = late_events(numbered, "arrival", 30, chunk=chunk).orderBy("arrival").select("arrival", "is_late").collect()
        assert [tuple(r) for r in found] == expected


def test_settings_checked():
    with pytest.raises(ValueError):
        WindowSettings(tumbling_sec=0)
    assert S.pane_sec(W.ALL_KINDS) == 60 and S.order_slice_sec(W.ALL_KINDS) == 10
