"""The window operator of streams, driven batch by batch without a stream, against plain accumulation."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import accumulate
from hypothesis import given, settings
from hypothesis import strategies as st

from packetlens.operators.windows import ALL_KINDS
from packetlens.operators.zscore import advance
from packetlens.settings import WindowSettings
from packetlens.streaming import containers, hosts, scores


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1 << 40), st.integers(1, 9000), st.sampled_from([1, 2, 13, 70_000])), max_size=5))
def test_sets_round_trip(blocks):
    values = np.unique(np.concatenate([np.zeros(0, np.int64), *[a + np.arange(n) * step for a, n, step in blocks]]))
    held = containers.pack(values)
    assert containers.unpack(held).tolist() == values.tolist()
    assert len(held) <= 1 + 8 * len(values)
    assert containers.union([values[::2], values[1::2], values]).tolist() == values.tolist()


def test_crowded_sets_are_bounded_by_their_range():
    rng = np.random.default_rng(1)
    second = np.unique(rng.integers(0, 1_000_000, 3_000_000))  # a million microseconds
    assert len(containers.pack(second)) < 140_000


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(Value):
    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.timers, self.states = set(), {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Map())

    def listTimers(self):
        return iter(set(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class Operator:
    """Calls a processor as a stream does: rows of a batch, then timers behind the watermark."""

    def __init__(self, make):
        self.make, self.keys = make, {}

    def batch(self, groups, watermark_ms):
        out = []
        for key in groups:
            if key not in self.keys:
                self.keys[key] = (self.make(), Handle())
                self.keys[key][0].init(self.keys[key][1])
        for key, (processor, handle) in self.keys.items():
            if key in groups:
                out += list(processor.handleInputRows(key, iter(groups[key]), Clock(watermark_ms)))
            for at in sorted(handle.timers):
                if at < watermark_ms and at in handle.timers:
                    handle.timers.remove(at)
                    out += list(processor.handleExpiredTimer(key, Clock(watermark_ms), None))
        out = [frame for frame in out if len(frame)]
        return pd.concat(out) if out else pd.DataFrame()


def panes(rows, settings, shares):
    """Grouped pane rows of (host, us, ip, port, length, protocol) packets, in two batches of Arrow."""
    groups = {}
    run = hosts._pane_rows(hosts.Windows(settings, ALL_KINDS).pane_us, shares)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("host_id", "us", "dst_ip", "dst_port", "pkt_len", "protocol"), r, strict=True)) for r in part])
               for part in (rows[::2], rows[1::2]) if part]
    for out in run(iter(batches)):
        for key, frame in out.to_pandas().groupby(["host_id", "share"]):
            groups.setdefault(key, []).append(frame)
    return groups


def batched(batches, settings, shares=3):
    """Rows reported in each batch, with a last one without packets; and the watermarks."""
    operator = Operator(lambda: hosts.HostWindows(hosts.Windows(settings, ALL_KINDS)))
    top, marks, out = None, [], []
    for rows in [*batches, []]:
        mark = 0 if top is None else max(0, top // 1000 - settings.watermark_sec * 1000)
        marks.append(mark * 1000)
        out.append(operator.batch(panes(rows, settings, shares), mark))
        top = max([r[1] for r in rows] + ([] if top is None else [top]), default=None)
    return out, marks, operator


def merged(frame):
    if not len(frame):
        return {}
    frame = frame[frame["window_type"] != hosts.LATE]
    sums = frame.groupby(["host_id", "window_type", "start_us", "end_us"]).agg({
        **{c: "sum" for c in ("packets", "bytes", "tcp", "udp", "gap_high", "gap_low", "uniq_dst_ip", "uniq_dst_port")},
        "first_us": "min", "last_us": "max"})
    return {k: (r.packets, r.bytes, r.tcp, r.udp, r.gap_high * 2 ** 30 + r.gap_low, r.uniq_dst_ip, r.uniq_dst_port) for k, r in zip(sums.index, sums.itertuples())}


def traffic(seed, n, spread):
    rng = random.Random(seed)
    us, out = 1_000_000_000, []
    for _ in range(n):
        us += rng.choice([0, 1, 900, 40_000, 1_000_000, rng.randrange(1, spread)])
        out.append((rng.choice("ab"), us, rng.choice([1, 2, 2 ** 32 - 1, rng.randrange(2 ** 32)]), rng.randrange(5), rng.randrange(1500), rng.choice([6, 17, 1])))
    return out


def squares(times):
    times = sorted(times)
    return sum((b - a) ** 2 for a, b in zip(times, times[1:]))


SETTINGS = [WindowSettings(), WindowSettings(tumbling_sec=90, sliding_sec=150, session_timeout_sec=7),
            WindowSettings(tumbling_sec=30, sliding_sec=90, sliding_step_sec=30, session_timeout_sec=200, watermark_sec=5)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("s", SETTINGS)
def test_batches_in_order_of_time(seed, s):
    rows = traffic(seed, 400, 30_000_000)
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(400), 12))
    out, marks, operator = batched([rows[a:b] for a, b in zip([0, *cuts], [*cuts, 400])], s)
    found = {}
    for frame in out:
        for key, value in merged(frame).items():
            assert key not in found  # every window once
            found[key] = value
    top, wanted = marks[-1], {}
    by_window = {}
    for key, value in accumulate(rows, s).items():
        by_window[key] = value
    timeout = s.session_timeout_sec * 1_000_000
    for (host, kind, at), value in by_window.items():
        if (top - value[0] > timeout) if kind == "session" else value[0] <= top:
            inside = [r for r in rows if r[0] == host and (at <= r[1] <= value[0] if kind == "session" else at <= r[1] < value[0])]
            wanted[host, kind, at, value[0]] = (
                len(inside), sum(r[4] for r in inside), sum(r[5] == 6 for r in inside), sum(r[5] == 17 for r in inside),
                squares([r[1] for r in inside]), len({r[2] for r in inside}), len({r[3] for r in inside}))
    assert found == wanted and len(found) > 20
    assert not any((f["window_type"] == hosts.LATE).any() for f in out if len(f))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("s", SETTINGS)
def test_late_packets_join_open_windows_and_reopen_closed_ones(seed, s):
    rng = random.Random(seed)
    rows = traffic(seed, 400, 30_000_000)
    arrived = sorted(rows, key=lambda r: r[1] + rng.choice([0, 0, 0, 400_000_000]) * rng.random())
    batches = [arrived[k:k + 40] for k in range(0, 400, 40)]
    out, marks, _ = batched(batches, s)
    wanted, late = {}, 0
    windows = hosts.Windows(s, ALL_KINDS)
    for b, part in enumerate(batches):
        for r in part:
            late += r[1] < marks[b]
            for kind, start, end in windows.around(r[1] // windows.pane_us * windows.pane_us):
                step = next((k for k in range(b, len(marks)) if marks[k] >= end), None)
                if step is not None:
                    wanted.setdefault((step, r[0], kind, start, end), []).append(r)
    found = {}
    for step, frame in enumerate(out):
        for (host, kind, start, end), value in merged(frame).items():
            if kind != "session":
                found[step, host, kind, start, end] = value
    assert found == {
        k: (len(v), sum(r[4] for r in v), sum(r[5] == 6 for r in v), sum(r[5] == 17 for r in v), squares([r[1] for r in v]),
            len({r[2] for r in v}), len({r[3] for r in v})) for k, v in wanted.items()}
    told = sum(int(f[f["window_type"] == hosts.LATE]["packets"].sum()) for f in out if len(f))
    assert told == late and late > 5


def test_state_calls_follow_pages_not_values():
    """Ten times the packets and values in the same panes: no more calls."""
    calls = []
    for n in (300, 3000):
        rng = random.Random(n)
        rows = [("a", 10_000_000_000 + k * 300_000_000 // n, rng.randrange(2 ** 32), rng.randrange(60_000), 100, 6) for k in range(n)]
        _, _, operator = batched([rows[k::3] for k in range(3)], WindowSettings(), 2)
        calls.append(sum(handle.states["pages"].calls for _, handle in operator.keys.values()))
    assert calls[0] == calls[1]


def test_closed_windows_leave_no_state():
    rows = [("a", us * 1_000_000, 1, 1, 1, 6) for us in (10, 20, 130)]
    out, _, operator = batched([rows, [("b", 10 ** 10, 1, 1, 1, 6)], []], WindowSettings(), 2)
    for key, (_, handle) in operator.keys.items():
        if key[0] == "a":
            assert not handle.states["pages"].held and not handle.states["session"].exists() and not handle.timers


@pytest.mark.parametrize("cuts", [1, 5, 23])
def test_scores_in_order_of_windows(cuts):
    """Scores of windows that close out of order are those of one fold in order."""
    s = WindowSettings(session_timeout_sec=150)
    rows = traffic(7, 600, 40_000_000)
    size = -(-600 // cuts)
    closed, marks, _ = batched([rows[k:k + size] for k in range(0, 600, size)], s)
    operator = Operator(lambda: scores.HostScores(s.session_timeout_sec * 1_000_000, s.min_duration_sec, 0.2))
    found, passed = {}, 0
    for frame, mark in zip(closed, marks, strict=True):
        groups = {(h,): [f] for h, f in frame.groupby("host_id")} if len(frame) else {}
        out = operator.batch(groups, mark // 1000)
        if len(out):
            passed += int(out["z"].isna().sum())
            for r in out[out["z"].notna()].itertuples():
                found[r.host_id, r.window_type, r.start_us] = r.z
    assert passed == sum(map(len, closed))
    wanted = {}
    for host in "ab":
        mine = [(v[0], ALL_KINDS.index(k[1]), k[2], v) for k, v in accumulate(rows, s).items() if k[0] == host and v[0] < marks[-1] - 150_000_000]
        state = None
        for _, kind, start, v in sorted(mine, key=lambda x: x[:3]):
            state, z = advance(state, [v[3], v[4], float(v[5]), float(v[6])], 0.2)
            wanted[host, ALL_KINDS[kind], start] = z
    assert found.keys() == wanted.keys() and len(found) > 50
    for key, z in found.items():
        assert z == pytest.approx(wanted[key], rel=1e-9, abs=1e-9)


def test_a_task_sends_a_pane_once_however_its_packets_are_batched():
    rows = [("h1", 1_000_000 * k, 5 + k % 3, 80, 100, 6) for k in range(120)]
    names = ("host_id", "us", "dst_ip", "dst_port", "pkt_len", "protocol")
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True))]) for r in rows]
    sent = pa.Table.from_batches(hosts._pane_rows(60_000_000, 2)(iter(batches)))
    whole = pa.Table.from_batches(hosts._pane_rows(60_000_000, 2)(iter([pa.concat_batches(batches)])))
    assert len(sent) == 4 and sent.equals(whole)
    split = pa.Table.from_batches(hosts._pane_rows(60_000_000, 2, held=30)(iter(batches)))
    assert len(split) == 8 and sum(split["packets"].to_pylist()) == 120
