"""All windows of a stream of packets from one stateful operator.

Tasks first reduce the packets of each batch to panes: per host and pane the counts, and the distinct times, addresses and
ports as compressed sets. A pane divides every window and is no longer than the session timeout, so no session breaks
inside one. The sets are dealt to shares of the host by a hash of the value; each share hears when packets came, so all
shares close a window in the same batch, and ``merge_shares`` adds up what they report.

State of a share is one entry per page, a stretch of panes that no window boundary cuts. Uniting panes is the same in any
order, so late and repeated times cannot change a result, and a pane holds at most one bit for each microsecond however
many packets it had. A session that goes on is kept as its sums and the set of its values.

A window is reported when the watermark has reached its end, a session when the watermark is more than the timeout past
its last packet. Packets behind the watermark are counted. They join the windows that are still open; for windows that
were reported before, what came late is reported at once as a profile of its own, which replaces the older one where the
newest version is read. They change no session whose pane was folded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.windows import ALL_KINDS, MICROS
from ..settings import WindowSettings
from . import containers

LATE = "late"  # window type of the rows that count late packets
COUNTS = ("packets", "bytes", "tcp", "udp")
PANES = (
    "host_id string, share int, pane_us long, first_us long, last_us long, packets long, bytes long, tcp long, udp long, "
    "times binary, again binary, values binary")
CLOSED = (
    "host_id string, window_type string, start_us long, end_us long, first_us long, last_us long, packets long, bytes long, "
    "tcp long, udp long, gap_high long, gap_low long, uniq_dst_ip long, uniq_dst_port long")
_CLOSED_NAMES = [c.split()[0] for c in CLOSED.split(", ")]
_PAGE = (
    "pane array<long>, first array<long>, last array<long>, packets array<long>, bytes array<long>, tcp array<long>, "
    "udp array<long>, times array<binary>, values array<binary>")
_SESSION = "start long, last long, packets long, bytes long, tcp long, udp long, gap_sq string, seen binary"
_META = "closed_us long, folded_us long, timer_ms long, pages array<long>"
_NEVER = -(1 << 62)
# a value is an address, or a port with this bit; one without a value has the bit below
_PORT, _NONE = 1 << 33, 1 << 32


def _keys(column: pa.Array, mark: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False) | mark


def _share_of(keys: np.ndarray, shares: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)


PACKETS_HELD = 1 << 18  # packets that a task reduces together


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches with a time put together to at least ``rows``, but for the last; one that is larger stays whole."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.filter(batch.column("us").is_valid()))
        n += len(held[-1])
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _pane_rows(pane_us: int, shares: int, held: int = PACKETS_HELD) -> Callable:
    """Packets to (host, share, pane) rows, one for each ``held`` packets: state takes few rows of a pane, not one for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, held):
            named = batch.column("host_id").dictionary_encode()
            host = named.indices.fill_null(-1).to_numpy().astype(np.int64)
            us = batch.column("us").to_numpy()
            order = np.lexsort((us, us // pane_us, host))
            host, us = host[order], us[order]
            pane = us // pane_us
            heads = np.flatnonzero((np.diff(host, prepend=-2) != 0) | (np.diff(pane, prepend=_NEVER) != 0))
            ends = np.append(heads[1:], len(us))
            kind = batch.column("protocol").cast(pa.int64()).fill_null(-1).to_numpy()[order]
            size = batch.column("pkt_len").cast(pa.int64()).fill_null(0).to_numpy()[order]
            sums = [ends - heads, *(np.add.reduceat(x, heads) for x in (size, (kind == 6).astype(int), (kind == 17).astype(int)))]
            ips, ports = _keys(batch.column("dst_ip"), 0)[order], _keys(batch.column("dst_port"), _PORT)[order]
            names = [*named.dictionary.to_pylist(), None]
            rows = []
            for k, (a, b) in enumerate(zip(heads.tolist(), ends.tolist(), strict=True)):
                times = us[a:b]
                again = np.append(False, times[1:] == times[:-1])
                values = np.unique(np.concatenate([ips[a:b], ports[a:b]]))
                of = _share_of(values, shares)
                for share in range(shares):
                    first = share == 0
                    rows.append((
                        names[host[a]], share, int(pane[a]) * pane_us, int(times[0]), int(times[-1]),
                        *(int(s[k]) if first else 0 for s in sums), containers.pack(times[~again]) if first else b"",
                        times[again].tobytes() if first else b"", containers.pack(values[of == share])))
            columns = list(zip(*rows, strict=True))
            types = [pa.string(), pa.int32(), *[pa.int64()] * 7, *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in PANES.split(", ")])
    return run


@dataclass
class Pane:
    """What a share knows of one pane: first and last time, sums, and sets that may still be in parts."""

    first: int
    last: int
    sums: list[int]
    times: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def add(self, other: Pane) -> None:
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.times += other.times
        self.values += other.values

    def united(self) -> Pane:
        if len(self.times) > 1:
            self.times = [containers.union(self.times)]
        if len(self.values) > 1:
            self.values = [containers.union(self.values)]
        return self

    def gap_squares(self) -> int:
        """Sum of squared gaps inside the pane; a pane is short enough for 64 bits."""
        gaps = np.diff(self.united().times[0]) if self.times else np.zeros(0, np.int64)
        return int((gaps * gaps).sum())


class Windows:
    """The windows of a set of panes."""

    def __init__(self, settings: WindowSettings, kinds: tuple[str, ...]) -> None:
        s = settings
        self.pane_us = s.pane_sec(ALL_KINDS) * MICROS
        self.page_us = s.page_sec() * MICROS
        self.timeout_us = s.session_timeout_sec * MICROS if "session" in kinds else None
        self.fixed = [
            (kind, size * MICROS, step * MICROS)
            for kind, size, step in (("tumbling", s.tumbling_sec, s.tumbling_sec), ("sliding", s.sliding_sec, s.sliding_step_sec)) if kind in kinds]

    def around(self, pane_us: int) -> Iterator[tuple[str, int, int]]:
        """(kind, start, end) of the fixed windows, none from before the epoch, that hold a pane."""
        for kind, size, step in self.fixed:
            start = pane_us // step * step
            while start > pane_us - size:
                if start >= 0 or kind == "tumbling":
                    yield kind, start, start + size
                start -= step

    def last_end(self, pane_us: int) -> int:
        """End of the last fixed window that holds a pane."""
        return max((pane_us // step * step + size for _, size, step in self.fixed), default=_NEVER)


def _closed_row(host: str, kind: str, start: int, end: int, panes: list[Pane], gap_sq: int, values: np.ndarray) -> tuple:
    sums = [sum(p.sums[i] for p in panes) for i in range(len(COUNTS))]
    ports = int((values >= _PORT).sum())
    return (host, kind, start, end, panes[0].first, panes[-1].last, *sums, gap_sq >> 30, gap_sq % (1 << 30), len(values) - ports, ports)


def window_row(host: str, kind: str, start: int, end: int, panes: list[Pane]) -> tuple:
    """One closed window from its panes in order of time."""
    values = containers.union([v for p in panes for v in p.values])
    squares = 0
    if any(p.times for p in panes):  # the share that follows the times
        squares = sum(p.gap_squares() for p in panes) + sum((b.first - a.last) ** 2 for a, b in zip(panes, panes[1:]))
    return _closed_row(host, kind, start, end, panes, squares, values)


class HostWindows(StatefulProcessor):
    """One share of one host: open pages, the open session, and up to where all was reported."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page long", _PAGE)
        self.session = handle.getValueState("session", _SESSION)
        self.meta = handle.getValueState("meta", _META)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh: dict[int, Pane] = {}
        late = 0
        for frame in rows:
            for r in frame.itertuples(index=False):
                times = containers.unpack(r.times)
                pane = Pane(r.first_us, r.last_us, [r.packets, r.bytes, r.tcp, r.udp], [times] if len(times) else [],
                            [containers.unpack(r.values)] if r.values else [])
                if r.first_us < watermark and len(times):
                    late += int((times < watermark).sum() + (np.frombuffer(r.again, np.int64) < watermark).sum())
                if r.pane_us in fresh:
                    fresh[r.pane_us].add(pane)
                else:
                    fresh[r.pane_us] = pane
        out = self._advance(key[0], fresh, watermark)
        if late:
            out.append((key[0], LATE, watermark, watermark, watermark, watermark, late, *[0] * 7))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._advance(key[0], {}, timerValues.getCurrentWatermarkInMs() * 1000))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_CLOSED_NAMES)

    # pages

    def _load(self, page: int) -> dict[int, Pane]:
        held = self.pages.getValue((page,))
        out = {}
        for pane, first, last, *sums, times, values in zip(*held, strict=True):
            out[pane] = Pane(first, last, list(sums), [containers.unpack(times)] if times else [], [containers.unpack(values)] if values else [])
        return out

    def _store(self, page: int, panes: dict[int, Pane]) -> None:
        columns: list[list] = [[] for _ in range(9)]
        for at in sorted(panes):
            p = panes[at].united()
            row = (at, p.first, p.last, *p.sums, *(containers.pack(x[0]) if x else b"" for x in (p.times, p.values)))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        self.pages.updateValue((page,), tuple(columns))

    # one batch

    def _advance(self, host: str, fresh: dict[int, Pane], watermark: int) -> list[tuple]:
        w = self.windows
        closed, folded, timer, live = tuple(self.meta.get()) if self.meta.exists() else (_NEVER, _NEVER, -1, [])
        stored, live = set(live), set(live)
        out = self._again(host, fresh, closed)
        held: dict[int, dict[int, Pane]] = {}

        def page_of(pane: int) -> dict[int, Pane]:
            page = pane // w.page_us * w.page_us
            if page not in held:
                held[page] = self._load(page) if page in stored else {}
            return held[page]

        touched = set()
        for at, pane in fresh.items():
            if w.last_end(at) > closed or at >= folded:
                panes = page_of(at)
                if at in panes:
                    panes[at].add(pane)
                else:
                    panes[at] = pane
                touched.add(at // w.page_us * w.page_us)
        live |= touched
        if w.timeout_us is not None:
            out += self._fold(host, page_of, live, folded, watermark)
            folded = max(folded, watermark // w.pane_us * w.pane_us)
        out += self._close(host, page_of, live, closed, watermark)
        closed = max(closed, watermark)
        for page in sorted(live):
            last = page + w.page_us - w.pane_us
            if w.last_end(last) <= closed and (w.timeout_us is None or last < folded):
                if page in stored:
                    self.pages.removeKey((page,))
                live.discard(page)
            elif page in touched:
                self._store(page, held[page])
        timer = self._timer(live, page_of, closed, folded, watermark, timer)
        self.meta.update((closed, folded, timer, sorted(live)))
        return out

    def _again(self, host: str, fresh: dict[int, Pane], closed: int) -> list[tuple]:
        """Late parts of windows that were reported before."""
        parts: dict[tuple, list[int]] = {}
        for at in sorted(fresh):
            for window in self.windows.around(at):
                if window[2] <= closed:
                    parts.setdefault(window, []).append(at)
        return [window_row(host, *window, [fresh[at] for at in panes]) for window, panes in parts.items()]

    def _close(self, host: str, page_of: Callable, live: Iterable[int], closed: int, watermark: int) -> list[tuple]:
        """Fixed windows whose end the watermark has reached since the last time."""
        parts: dict[tuple, list[int]] = {}
        w = self.windows
        for page in sorted(live):
            ends = [window for window in w.around(page) if closed < window[2] <= watermark]  # the same for all panes of a page
            for window in ends:
                parts.setdefault(window, []).extend(sorted(page_of(page)))
        return [window_row(host, *window, [page_of(at)[at] for at in panes]) for window, panes in parts.items() if panes]

    def _fold(self, host: str, page_of: Callable, live: Iterable[int], folded: int, watermark: int) -> list[tuple]:
        """Chain the panes that the watermark has passed to sessions, and report those that are over."""
        w, out = self.windows, []
        over = watermark // w.pane_us * w.pane_us
        session = list(self.session.get()) if self.session.exists() else None
        before, seen = session is not None, [containers.unpack(session[7])] if session else []

        def report() -> None:
            start, last, *sums, squares, _ = session
            whole = Pane(start, last, sums)
            out.append(_closed_row(host, "session", start, last, [whole], int(squares), containers.union(seen)))

        ahead = None  # first packet after the panes that are folded
        for page in sorted(p for p in live if p + w.page_us > folded):
            panes = page_of(page)
            for at in sorted(panes):
                if at < folded:
                    continue
                pane = panes[at]
                if at >= over:
                    ahead = pane.first if ahead is None else min(ahead, pane.first)
                    continue
                if session is not None and pane.first - session[1] > w.timeout_us:
                    report()
                    session = None
                if session is None:
                    session, seen = [pane.first, pane.first, 0, 0, 0, 0, "0", b""], []
                gap = pane.first - session[1] if pane.times else 0
                session[1] = pane.last
                session[2:6] = [a + b for a, b in zip(session[2:6], pane.sums, strict=True)]
                session[6] = str(int(session[6]) + pane.gap_squares() + gap * gap)
                seen = [containers.union([*seen, *pane.values])] if pane.values else seen
        if session is not None and watermark - session[1] > w.timeout_us and (ahead is None or ahead - session[1] > w.timeout_us):
            report()
            session = None
        if session is not None:
            session[7] = containers.pack(seen[0]) if seen else b""
            self.session.update(tuple(session))
        elif before:
            self.session.clear()
        return out

    def _timer(self, live: Iterable[int], page_of: Callable, closed: int, folded: int, watermark: int, before: int) -> int:
        """Have the next window end, pane or session called, and return when; -1 if nothing is open."""
        w = self.windows
        ends = [window[2] for page in live for window in w.around(page) if window[2] > closed]
        if w.timeout_us is not None:
            ends += [at + w.pane_us for page in live if page + w.page_us > folded for at in page_of(page) if at >= folded]
            if self.session.exists():
                ends.append(self.session.get()[1] + w.timeout_us + 1)
        # a millisecond early: whether a timer at the watermark itself is called or not, it is called in time
        now = max(-(-min(ends) // 1000) - 1, watermark // 1000 + 1) if ends else -1
        if now != before:
            if before >= 0 and before in set(self.handle.listTimers()):
                self.handle.deleteTimer(before)
            if now >= 0:
                self.handle.registerTimer(now)
        return now


def closed_rows(
    packets: DataFrame, settings: WindowSettings = WindowSettings(), shares: int = 16, kinds: tuple[str, ...] = ALL_KINDS,
) -> DataFrame:
    """Closed windows of a stream in ``shares`` rows each, and the counts of late packets; see ``merge_shares``.

    Packets without a time are left out; one without an address or port counts as one more value.
    """
    windows = Windows(settings, kinds)
    slim = packets.withWatermark("ts", f"{settings.watermark_sec} seconds").select(
        "host_id", F.unix_micros("ts").alias("us"), "dst_ip", "dst_port", "pkt_len", "protocol")
    panes = slim.mapInArrow(_pane_rows(windows.pane_us, shares), PANES)
    return panes.groupBy("host_id", "share").transformWithStateInPandas(HostWindows(windows), CLOSED, "Append", "EventTime")
