"""Settings with their defaults; every one is an ordinary function argument."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import gcd

# Longest time slice whose sum of squared gaps (in square microseconds) is sure to fit a 64-bit
# integer: the gaps of a slice add up to at most its length, so their squares add up to at most
# the square of it.
MAX_SLICE_SEC = 3000


def largest_divisor(n: int, at_most: int) -> int:
    """Largest divisor of ``n`` that is not above ``at_most``."""
    return next(d for d in range(min(n, at_most), 0, -1) if n % d == 0)


# ---- fixed values: the defaults of the settings below, and the names of topics, detectors and settings ----


@dataclass(frozen=True)
class WindowSettings:
    """Sizes of the three windows, in whole seconds.

    ``slice_sec`` bounds how much of one host's traffic is sorted together: packets are ordered
    within (host, slice) only, so a host that holds a third of all rows is spread over as many
    groups as it has slices. It never changes a result.
    ``state_slice_sec`` does the same for streams, where the times of one host and slice are one
    row of state until the slice is over.
    """

    tumbling_sec: int = 60
    sliding_sec: int = 300
    sliding_step_sec: int = 60
    session_timeout_sec: int = 120
    watermark_sec: int = 30
    slice_sec: int = 10
    state_slice_sec: int = 1
    min_duration_sec: float = 1e-6

    def __post_init__(self) -> None:
        sizes = (self.tumbling_sec, self.sliding_sec, self.sliding_step_sec, self.session_timeout_sec, self.slice_sec,
                 self.state_slice_sec)
        if any(int(s) != s or s < 1 for s in sizes):
            raise ValueError(f"window sizes are whole seconds above zero, got {sizes}")

    def pane_sec(self, kinds: tuple[str, ...]) -> int:
        """Longest slot that every window of ``kinds`` is a whole number of.

        It is at most the session timeout, so no session can break inside a pane.
        """
        common = 0
        if "tumbling" in kinds:
            common = gcd(common, self.tumbling_sec)
        if "sliding" in kinds:
            common = gcd(common, self.sliding_sec, self.sliding_step_sec)
        limit = MAX_SLICE_SEC
        if "session" in kinds:
            limit = min(limit, self.session_timeout_sec)
            common = common or limit
        return largest_divisor(common, limit)

    def page_sec(self) -> int:
        """Longest slot that no boundary of a tumbling or sliding window cuts; panes divide it."""
        return gcd(self.tumbling_sec, self.sliding_sec, self.sliding_step_sec)

    def order_slice_sec(self, kinds: tuple[str, ...]) -> int:
        return largest_divisor(self.pane_sec(kinds), self.slice_sec)

    def stream_slice_sec(self, pane_sec: int) -> int:
        return largest_divisor(pane_sec, self.state_slice_sec)


@dataclass(frozen=True)
class Thresholds:
    """Limits of the four rules."""

    pps: float = 10_000.0
    bps: float = 100_000_000.0
    uniq_dst_port_scan: int = 100
    uniq_dst_ip_scan: int = 100
    beacon_std_max: float = 0.5
    beacon_min_conns: int = 5


@dataclass(frozen=True)
class Topics:
    """Queue names and the consumer options that go to the Kafka source and sink."""

    brokers: str = "127.0.0.1:9092"
    group_id: str = "packetlens"
    packets: str = "traffic.packets"
    hosts: str = "traffic.hosts"
    alerts: str = "traffic.alerts"
    profiles: str = "traffic.profiles"
    starting_offsets: str = "latest"


@dataclass(frozen=True)
class AnalyzerSettings:
    detectors: tuple[str, ...] = ("rule", "isoforest")
    ml_core: str = "isoforest"
    rule_weight: float = 0.6
    ml_weight: float = 0.4
    model_root: str = "models"
    model_version: str = "v1"
    thresholds: Thresholds = field(default_factory=Thresholds)
    windows: WindowSettings = field(default_factory=WindowSettings)
    topics: Topics = field(default_factory=Topics)


# -------------------------------------------------------------------------------------------------
