"""Protobuf messages to Arrow columns and back, whole columns at a time.

Decoding puts a cursor on every message of a column and moves all of them from field to field in step; where varints
stop is found once for the whole buffer. Nested messages are the next level: all events of all messages are read in step,
so the number of numpy calls follows the number of fields, not the number of messages. Encoding first adds up the size of every
field, then writes each field of all messages at its place.

Like the usual parsers: of a repeated scalar the last one counts, unknown fields and known ones of another wire type
are skipped, and what is cut short, has a field number zero or text that is no UTF-8 makes the message NULL. Groups,
which the third version of the format no longer has, make it NULL too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
_KNOWN = np.isin(np.arange(8), (VARINT, FIXED64, BYTES, FIXED32))
_SIZES = np.array([0, 8, 0, 0, 0, 4, 0, 0])  # of values without a size of their own
_WIRE = {"uint64": VARINT, "int64": VARINT, "uint32": VARINT, "fixed32": FIXED32, "string": BYTES}


def wire_type(kind: str) -> int:
    """How a field of a kind is written; messages, maps and lists of messages are bytes, enums are numbers."""
    return _WIRE.get(kind, BYTES if " " in kind else VARINT)


@dataclass
class Step:
    """One field of each of some messages. ``row`` is None if it is one of every message in order; a number or wire type that all share is an int."""

    row: np.ndarray | None
    number: np.ndarray | int
    wire: np.ndarray | int
    value: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def of(self, number: int, wire: int) -> Step | None:
        """The part with a field of this number and wire type."""
        here = (self.number == number) & (self.wire == wire)
        if isinstance(here, bool | np.bool_):
            return self if here else None
        if not here.any():
            return None
        row = np.flatnonzero(here) if self.row is None else self.row[here]
        return Step(row, number, wire, self.value[here], self.start[here], self.end[here])


@dataclass
class Fields:
    """Fields found in ``n`` messages, in the order in which each message has them."""

    n: int
    steps: list[Step]

    def last(self, number: int, wire: int) -> np.ndarray:
        """The last value of a field in each message; zero without one."""
        out = np.zeros(self.n, np.uint64)
        for step in self.steps:
            found = step.of(number, wire)
            if found is not None:
                out[slice(None) if found.row is None else found.row] = found.value
        return out

    def ranges(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Message, start and end of all byte ranges of a field, message by message."""
        parts = [p for p in (step.of(number, BYTES) for step in self.steps) if p is not None]
        if not parts:
            return tuple(np.zeros((3, 0), np.int64))
        row = np.concatenate([np.arange(self.n) if p.row is None else p.row for p in parts])
        order = np.argsort(row, kind="stable") if len(parts) > 1 else slice(None)
        return row[order], np.concatenate([p.start for p in parts])[order], np.concatenate([p.end for p in parts])[order]


def _shared(values: np.ndarray) -> np.ndarray | int:
    return int(values[0]) if (values == values[0]).all() else values


class Buffer:
    """The bytes of a column, with where each varint stops."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.append(data, np.zeros(16, np.uint8))
        n = len(self.data)
        self.stop = np.minimum.accumulate(np.where(self.data < 128, np.arange(n), n)[::-1])[::-1]

    def varints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and the places after them; a varint of more than ten bytes ends far beyond the data."""
        last = self.stop[at]
        value = (self.data[at] & 0x7F).astype(np.uint64)
        longest = int((last - at).max(initial=0))
        for k in range(1, min(10, longest + 1)):
            on = np.flatnonzero(last - at >= k)
            every = len(on) == len(at)
            more = self.data[at + k if every else at[on] + k] & np.uint64(0x7F)
            value[slice(None) if every else on] |= more << np.uint64(7 * k)
        after = last + 1
        return value, after if longest < 10 else np.where(last - at < 10, after, len(self.data) * 2)

    def scan(self, start: np.ndarray, end: np.ndarray) -> tuple[Fields, np.ndarray]:
        """All fields of the messages in some byte ranges, and which messages are broken."""
        n = len(start)
        broken, steps = np.zeros(n, bool), []
        row, at, limit = None, start.astype(np.int64), end

        def keep(mask: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
            nonlocal row, limit
            row, limit = np.flatnonzero(mask) if row is None else row[mask], limit[mask]
            return [c[mask] for c in columns]

        def mark(bad: np.ndarray) -> None:
            broken[np.flatnonzero(bad) if row is None else row[bad]] = True

        while len(at):
            more = at < limit
            if not more.all():
                (at,) = keep(more, at)
                if not len(at):
                    break
            tag, at = self.varints(at)
            wire, number = (tag & np.uint64(7)).astype(np.int64), (tag >> np.uint64(3)).astype(np.int64)
            bad = (at > limit) | (number == 0) | (tag >= np.uint64(1 << 32)) | ~_KNOWN[wire]
            if bad.any():
                mark(bad)
                at, wire, number = keep(~bad, at, wire, number)
                if not len(at):
                    break
            shared = _shared(wire)
            if isinstance(shared, int) and shared in (VARINT, BYTES):
                value, begin = self.varints(at)
            else:
                value, begin = np.zeros(len(at), np.uint64), at
                counted = np.flatnonzero((wire == VARINT) | (wire == BYTES))
                if len(counted):
                    begin = at.copy()
                    value[counted], begin[counted] = self.varints(at[counted])
            after = begin + _SIZES[wire]
            sized = np.flatnonzero(wire == BYTES) if not isinstance(shared, int) else slice(None) if shared == BYTES else None
            if sized is not None:
                after[sized] += np.minimum(value[sized], np.uint64(1 << 40)).astype(np.int64)
            bad = after > limit
            if bad.any():
                mark(bad)
                wire, number, value, begin, after = keep(~bad, wire, number, value, begin, after)
                if not len(after):
                    break
            fixed = np.flatnonzero(wire == FIXED32)
            if len(fixed):
                quads = self.data[begin[fixed][:, None] + np.arange(4)]
                value[fixed] = quads.view("<u4").reshape(-1)
            steps.append(Step(row, _shared(number), _shared(wire), value, begin, after))
            at = after
        return Fields(n, steps), broken

    def texts(self, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Byte ranges as strings, and which of them are no UTF-8."""
        sizes = end - start
        bounds = np.append(0, np.cumsum(sizes))
        flat = self.data[np.repeat(start - bounds[:-1], sizes) + np.arange(bounds[-1])]
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
        try:
            return held.cast(pa.binary()).cast(pa.string()), np.zeros(len(sizes), bool)
        except pa.ArrowInvalid:
            out, bad = [], np.zeros(len(sizes), bool)
            for k, raw in enumerate(held.to_pylist()):
                try:
                    out.append(raw.decode())
                except UnicodeDecodeError:
                    out.append("")
                    bad[k] = True
            return pa.array(out, pa.string()), bad


def _last_texts(buffer: Buffer, fields: Fields, number: int, n: int) -> tuple[pa.Array, np.ndarray]:
    """The last string of a field in each of ``n`` messages, and the messages in which any of them is no UTF-8."""
    row, start, end = fields.ranges(number)
    texts, bad = buffer.texts(start, end)
    broken, last = np.zeros(n, bool), np.full(n, len(texts))
    broken[row[bad]] = True
    last[row] = np.arange(len(texts))
    return pa.concat_arrays([texts, pa.array([""])]).take(pa.array(last)), broken


def _number(value: np.ndarray, kind: str, target: pa.DataType) -> pa.Array:
    """Varints as the numbers of a kind: 64 bits signed or as they are, 32 bits cut off."""
    if kind in ("uint64", "int64"):
        return pa.array(value.view(np.int64)).cast(target)
    return pa.array((value & np.uint64(0xFFFFFFFF)).astype(np.int64)).cast(target, safe=False)


def _label(value: np.ndarray, names: dict[int, str]) -> pa.Array:
    """Names of an enum's numbers; a number without a name is its text."""
    value = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    if len(value) and (value == value[0]).all():
        return pa.array([names.get(int(value[0]), str(int(value[0])))], pa.string()).take(pa.array(np.zeros(len(value), np.int64)))
    kinds, which = np.unique(value, return_inverse=True)
    return pa.array([names.get(int(k), str(int(k))) for k in kinds], pa.string()).take(pa.array(which))


SLICE_BYTES, SLICE_VALUES = 1 << 20, 1 << 15  # of a column that are read or written together


def _slices(weights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of rows of at most ``most`` together, or of one row that is more."""
    ends, out, a = np.cumsum(weights), [], 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(ends, most + (int(ends[a - 1]) if a else 0), "right")))
        out.append((a, b))
        a = b
    return out or [(0, 0)]


class Codec:
    """One message type: its shape by name, and the enums its fields may have.

    Columns are worked on in slices, so that memory beside a column and its result does not follow the size of either.
    """

    def __init__(self, name: str, messages: dict[str, list], enums: dict[str, dict[int, str]]) -> None:
        self.name, self.messages, self.enums = name, messages, enums

    # from bytes

    def decode(self, values: pa.Array, target: pa.StructType) -> pa.Array:
        """Message bytes as structs of ``target``; NULL for NULL and for what cannot be parsed."""
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [self._decoded(values.slice(a, b - a), target) for a, b in _slices(sizes + 64, SLICE_BYTES)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    def _decoded(self, values: pa.Array, target: pa.StructType) -> pa.Array:
        values = values.cast(pa.large_binary())
        bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
        raw = values.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[:bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        start = bounds[:-1] - bounds[0]
        missing = np.asarray(values.is_null())
        out, broken = self._columns(self.name, Buffer(data[bounds[0]:]), start, np.where(missing, start, bounds[1:] - bounds[0]), target)
        return pa.StructArray.from_arrays(out, fields=list(target), mask=pa.array(missing | broken))

    def _columns(self, name: str, buffer: Buffer, start: np.ndarray, end: np.ndarray, target: pa.StructType) -> tuple[list[pa.Array], np.ndarray]:
        fields, broken = buffer.scan(start, end)
        out = []
        for field, kind, number in self.messages[name]:
            kind_of = target.field(field).type
            if " " in kind:
                column, bad = self._repeated(kind, buffer, fields.ranges(number), len(start), kind_of)
            elif kind == "string":
                column, bad = _last_texts(buffer, fields, number, len(start))
            elif kind in self.enums:
                column, bad = _label(fields.last(number, VARINT), self.enums[kind]), None
            else:
                column, bad = _number(fields.last(number, wire_type(kind)), kind, kind_of), None
            if bad is not None:
                broken = broken | bad
            out.append(column)
        return out, broken

    def _repeated(self, kind: str, buffer: Buffer, found: tuple, n: int, target: pa.DataType) -> tuple[pa.Array, np.ndarray]:
        broken, (row, first, last) = np.zeros(n, bool), found
        head, *rest = kind.split()
        if head == "repeated":
            columns, bad = self._columns(rest[0], buffer, first, last, target.value_type)
            broken[row[bad]] = True
            counts = np.bincount(row, minlength=n)
            inner = pa.StructArray.from_arrays(columns, fields=list(target.value_type))
            bounds = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            return pa.ListArray.from_arrays(bounds, inner, type=target), broken
        # a map is a list of messages with key 1 and value 2; of equal keys the last counts
        fields, bad = buffer.scan(first, last)
        broken[row[bad]] = True
        keys = fields.last(1, wire_type(rest[0])) & np.uint64(0xFFFFFFFF)
        texts, unreadable = _last_texts(buffer, fields, 2, len(row))
        broken[row[unreadable]] = True
        order = np.lexsort((np.arange(len(keys)), keys, row))
        final = np.append((np.diff(row[order]) != 0) | (np.diff(keys[order].view(np.int64)) != 0), True)[:len(order)]
        kept = np.sort(order[final])
        bounds = pa.array(np.append(0, np.cumsum(np.bincount(row[kept], minlength=n))), pa.int32())
        return pa.MapArray.from_arrays(bounds, _number(keys[kept], rest[0], target.key_type), texts.take(pa.array(kept))), broken

    # to bytes

    def encode(self, rows: pa.Array) -> pa.Array:
        """Structs as message bytes, fields in the order of their numbers; zero, empty and NULL fields are left out."""
        parts = [self._encoded(rows.slice(a, b - a)) for a, b in _slices(self._weights(rows), SLICE_VALUES)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    def _weights(self, rows: pa.Array) -> np.ndarray:
        """How many values each row has, those of lists and maps counted one by one."""
        out = np.ones(len(rows), np.int64)
        for column in rows.flatten():
            if pa.types.is_list(column.type) or pa.types.is_map(column.type):
                out += np.diff(column.offsets.to_numpy())
        return out

    def _encoded(self, rows: pa.Array) -> pa.Array:
        data, bounds = self._bytes(self.name, rows)
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        return pc.if_else(rows.is_valid(), held, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    def _bytes(self, name: str, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The messages of structs one after another, and where each starts."""
        n = len(rows)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, bytes, bounds of its pieces; ordered by field
        columns = rows.flatten()  # with the gaps of the structs themselves
        for field, kind, number in self.messages[name]:
            pieces.append(self._field(kind, number, columns[rows.type.get_field_index(field)]))
        sizes = np.zeros((n, len(pieces)), np.int64)
        for k, (row, _, bounds) in enumerate(pieces):
            np.add.at(sizes[:, k], row, np.diff(bounds))
        place = np.append(0, np.cumsum(sizes))[:-1].reshape(n, len(pieces))
        out = np.zeros(int(sizes.sum()), np.uint8)
        for k, (row, data, bounds) in enumerate(pieces):
            if len(row):  # the pieces of a row follow each other, and are in order of rows
                heads = np.flatnonzero(np.diff(row, prepend=-1))
                start = bounds[heads]
                length = np.diff(start, append=bounds[-1])
                out[np.repeat(place[row[heads], k] - start, length) + np.arange(bounds[-1])] = data
        return out, np.append(0, np.cumsum(sizes.sum(axis=1)))

    def _field(self, kind: str, number: int, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tag = np.uint8(number << 3 | wire_type(kind))
        head, *rest = kind.split()
        if head == "repeated":
            inner, bounds = self._bytes(rest[0], column.flatten())
            row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
            return _delimited(tag, row, inner, bounds)
        if head == "map":
            bounds = column.offsets.to_numpy()
            lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(bounds), 0)
            row = np.repeat(np.arange(len(column)), lengths)
            inside = np.repeat(bounds[:-1] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(len(row))
            keys, values = (c.take(pa.array(inside)) for c in (column.keys, column.items))
            order = np.lexsort((keys.to_numpy(zero_copy_only=False), row))  # as deterministic writers do
            parts = [self._field(part, k, c.take(pa.array(order))) for k, (part, c) in enumerate(zip(rest, (keys, values), strict=True), 1)]
            whole = _joined(parts, len(row), always=True, kinds=rest)
            return _delimited(tag, row, *whole)
        if kind == "string":
            texts = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
            row = np.flatnonzero(np.diff(bounds))
            return _delimited(tag, row, data, np.append(bounds[row], bounds[-1]) - bounds[0])
        if kind in self.enums:
            codes = {label: code for code, label in self.enums[kind].items()}
            held = column.fill_null("").dictionary_encode()
            numbers = np.array([codes[x] if x in codes else int(x or 0) for x in held.dictionary.to_pylist()], np.int64)
            value = numbers[held.indices.to_numpy()] if len(numbers) else np.zeros(len(column), np.int64)
        else:
            value = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        value = value.astype(np.int64).view(np.uint64)
        row = np.flatnonzero(value)
        value = value[row]
        if kind == "fixed32":
            body = (value[:, None] >> (np.uint64(8) * np.arange(4, dtype=np.uint64))).astype(np.uint8)
            data = np.concatenate([np.full((len(row), 1), tag), body], axis=1)
            return row, data.reshape(-1), np.arange(len(row) + 1) * 5
        body, bounds = varint_bytes(value)
        return row, *_prefixed(tag, body, bounds)


def varint_bytes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varints one after another, and where each starts."""
    size = np.ones(len(value), np.int64)
    for k in range(1, 10):
        size += value >> np.uint64(7 * k) > 0
    bounds = np.append(0, np.cumsum(size))
    out = np.zeros(bounds[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        more = np.where(size[on] > k + 1, 0x80, 0).astype(np.uint8)
        out[bounds[:-1][on] + k] = ((value[on] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more
    return out, bounds


def _prefixed(tag: np.uint8, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte before each piece."""
    n = len(bounds) - 1
    out, moved = np.full(len(data) + n, tag), bounds + np.arange(n + 1)
    inside = np.ones(len(out), bool)
    inside[moved[:-1]] = False
    out[inside] = data
    return out, moved


def _interleaved(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The i-th piece of ``a`` followed by the i-th piece of ``b``."""
    a_size, b_size = np.diff(a_bounds), np.diff(b_bounds)
    bounds = np.append(0, np.cumsum(a_size + b_size))
    out = np.zeros(bounds[-1], np.uint8)
    out[np.repeat(bounds[:-1] - a_bounds[:-1], a_size) + np.arange(len(a))] = a
    out[np.repeat(bounds[:-1] + a_size - b_bounds[:-1], b_size) + np.arange(len(b))] = b
    return out, bounds


def _delimited(tag: np.uint8, row: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces with their tag and size before them."""
    sizes, size_bounds = _prefixed(tag, *varint_bytes(np.diff(bounds).astype(np.uint64)))
    return row, *_interleaved(sizes, size_bounds, data, bounds)


def _joined(parts: list[tuple], n: int, always: bool, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fields of ``n`` messages put together; with ``always``, those that are zero or empty are written too."""
    out, bounds = np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    for number, ((row, data, own), kind) in enumerate(zip(parts, kinds, strict=True), 1):
        sizes = np.zeros(n, np.int64)
        sizes[row] = np.diff(own)
        empty = np.setdiff1d(np.arange(n), row) if always else row[:0]
        blank = np.array([number << 3 | wire_type(kind), 0], np.uint8)
        sizes[empty] = 2
        edges = np.append(0, np.cumsum(sizes))
        whole = np.zeros(edges[-1], np.uint8)
        whole[np.repeat(edges[:-1][row] - own[:-1], np.diff(own)) + np.arange(len(data))] = data
        whole[(edges[:-1][empty][:, None] + np.arange(2)).reshape(-1)] = np.tile(blank, len(empty))
        out, bounds = _interleaved(out, bounds, whole, edges)
    return out, bounds
