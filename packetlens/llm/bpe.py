"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct pieces of a batch of texts are laid out as one symbol array. An index maps each mergeable
pair to all its positions; ranks that occur are taken in ascending order from a heap, all positions of
the pair are merged at once, and the positions around them enter the lists of their new pairs.
Within a piece this is the usual order of merges, since pieces do not touch each other.

The vocabulary is read on the driver and sent to tasks once; its size does not depend on the data.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

# fixed values: kinds of code points in the splitting pattern, and the contractions it knows
OTHER, LETTER, NUMBER, SPACE = range(4)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# fixed values: characters with the property White_Space outside ASCII and the separator categories
EXTRA_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
CHUNK_BYTES = 3 << 20  # of text encoded at once; arrays of about 60 times that size are held


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Merge table and bytes of a byte-level BPE vocabulary."""

    byte_ids: np.ndarray      # id of each byte
    left: np.ndarray          # pair and result of each merge, by rank
    right: np.ndarray
    result: np.ndarray
    raw: list[bytes]          # bytes of each id
    special: dict[str, int]   # strings that always become one id

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a tokenizer file with a byte-level BPE model, read on the driver."""
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        ids = held["model"]["vocab"]
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in held["model"]["merges"]]
        special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        raw = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for piece, i in ids.items():
            raw[i] = bytes(to_byte[c] for c in piece)
        for piece, i in special.items():
            raw[i] = piece.encode()
        return Vocabulary(
            np.array([ids[c] for c in byte_characters()], np.int64), np.array([ids[a] for a, _ in pairs], np.int64),
            np.array([ids[b] for _, b in pairs], np.int64), np.array([ids[a + b] for a, b in pairs], np.int64), raw, special)


class Kinds:
    """Kind of code points by their Unicode category, looked up in blocks as they occur."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint8)
        self.known = np.zeros(0x1100, bool)

    def of(self, points: np.ndarray) -> np.ndarray:
        blocks = np.bincount(points >> 8, minlength=len(self.known)) > 0
        for block in np.flatnonzero(blocks & ~self.known).tolist():
            for c in range(block << 8, (block + 1) << 8):
                first = unicodedata.category(chr(c))[0]
                self.table[c] = SPACE if c in EXTRA_SPACE else {"L": LETTER, "N": NUMBER, "Z": SPACE}.get(first, OTHER)
            self.known[block] = True
        return self.table[points]


def piece_starts(points: np.ndarray, kind: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Places where pieces start: runs of one kind with a space before them; contractions stand alone.

    ``points`` are code points of several texts and ``kind`` their kinds; ``row_start`` (one longer) marks where texts start.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    run = row_start[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white space before other text starts a piece of its own; a blank also takes the text after it
    last_space = space.copy()
    last_space[:-1] &= ~space[1:] & ~row_start[1:n]
    last_space[-1] = False
    start = run | last_space
    joined = np.zeros(n, bool)
    joined[1:] = last_space[:-1] & (points[:-1] == 32)
    start &= ~joined
    # contractions: an apostrophe that starts a piece, and the letters after it
    for at in np.flatnonzero((points == 39) & start):
        for short in CONTRACTIONS:
            end = at + len(short)
            if end <= n and not row_start[at + 1:end].any() and all(points[at + k] == ord(c) for k, c in enumerate(short)):
                if end < n and kind[end] == LETTER and not row_start[end]:
                    start[end] = True
                start[at + 1:end] = False
                break
    return np.flatnonzero(start)


class PairIndex:
    """Merges all mergeable pairs of a symbol array, lowest rank first."""

    def __init__(self, vocabulary: Vocabulary):
        self.left, self.right, self.result = vocabulary.left, vocabulary.right, vocabulary.result
        keys = (self.left << 20) | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        key = (a << 20) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges and the piece of each; neighbours are only merged within a piece."""
        n = len(symbols)
        symbols = symbols.copy()
        place = np.arange(n)
        same = np.zeros(n + 1, bool)
        same[1:n] = piece[1:] == piece[:-1]
        after = np.where(same[1:], place + 1, -1)
        before = np.where(same[:n], place - 1, -1)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, group in zip(rank[edges].tolist(), np.split(at, edges[1:]), strict=True):
                if r in lists:
                    lists[r].append(group)
                else:
                    lists[r] = [group]
                    heapq.heappush(active, r)

        enter(place)
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            # a pair stands at a place once at most, so no place is listed twice
            at = np.concatenate(found) if len(found) > 1 else found[0]
            a, b = self.left[r], self.right[r]
            at = at[(symbols[at] == a) & (after[at] >= 0)]
            at = at[symbols[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping pairs, every second one from the left
                at = np.sort(at)
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbols[at] = self.result[r]
            symbols[gone] = -1
            after[at] = follow
            after[gone] = -1
            inner = follow >= 0
            before[follow[inner]] = at[inner]
            enter(at)
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            enter(ahead[symbols[ahead] != self.result[r]])  # the others are in the first list
        alive = symbols >= 0
        return symbols[alive], piece[alive]


class Encoder:
    """Encodes batches of texts; made once per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.kinds = Kinds()
        self.index = PairIndex(vocabulary)

    def _points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([0, *map(len, texts)])
        mark = np.zeros(len(points) + 1, bool)
        mark[ends] = True
        return points, mark

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts, owner, fixed = [], [], []  # special strings are cut out first
        for row, text in enumerate(texts):
            for part, special in self._cut(text):
                parts.append(part)
                owner.append(row)
                fixed.append(special)
        points, mark = self._points(["" if f >= 0 else p for p, f in zip(parts, fixed, strict=True)])
        starts = piece_starts(points, self.kinds.of(points), mark)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        names = tokens.span_hashes(points, starts, ends)
        kinds, shown, which = np.unique(names, return_index=True, return_inverse=True)
        flat, bounds = self._encode_pieces(points, starts[shown], ends[shown])
        out_size = np.diff(bounds)
        sizes = out_size[which] if len(which) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(bounds[which] - total[:-1], sizes) + np.arange(total[-1])] if len(which) else flat[:0]
        part_end = np.cumsum([0 if f >= 0 else len(p) for p, f in zip(parts, fixed, strict=True)])
        cut = total[np.searchsorted(starts, part_end)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        begin = 0
        for row, special, end in zip(owner, fixed, cut.tolist(), strict=True):
            out[row].append(np.array([special]) if special >= 0 else ids[begin:end])
            begin = end
        return [np.concatenate(x) if len(x) != 1 else x[0] for x in out]

    def _cut(self, text: str) -> list[tuple[str, int]]:
        found = [(text, -1)]
        for special, i in self.vocabulary.special.items():
            if special in text:
                parts = []
                for piece, held in found:
                    if held >= 0:
                        parts.append((piece, held))
                        continue
                    for k, rest in enumerate(piece.split(special)):
                        parts += ([(special, i)] if k else []) + [(rest, -1)]
                found = parts
        return found

    def _encode_pieces(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and their bounds."""
        sizes = ends - starts
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        first = np.cumsum(sizes) - sizes
        chars = points[np.repeat(starts - first, sizes) + np.arange(sizes.sum())]
        data, width = utf8(chars)
        piece = np.repeat(np.repeat(np.arange(len(starts)), sizes), width)
        symbols, piece = self.index.merge(self.vocabulary.byte_ids[data], piece)
        return symbols, np.searchsorted(piece, np.arange(len(starts) + 1))


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, and how many each takes."""
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode(), np.uint8)
    return data, width


def _encode(vocabulary: Vocabulary, names: list[str], text: str, out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            column = batch.column(text)
            sizes = tokens.chunks(column, CHUNK_BYTES)
            for a, b, _, _ in sizes:
                ids = encoder.encode([t or "" for t in column.slice(a, b - a).to_pylist()])
                bounds = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
                kept = [batch.column(n).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, lists], [*names, out])
    return run


def _decode(vocabulary: Vocabulary, names: list[str], ids: str, out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocabulary.raw
        for batch in batches:
            column = batch.column(ids)
            values, bounds = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()])
            for a in range(0, len(column), 256):
                b = min(a + 256, len(column))
                texts = [
                    b"".join([raw[i] if 0 <= i < len(raw) else b"" for i in values[s:e].tolist()]).decode("utf-8", "replace")
                    for s, e in zip(bounds[a:b], bounds[a + 1:b + 1], strict=True)]
                kept = [batch.column(n).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*names, out])
    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in column ``out`` (replaced if it exists).

    Null and empty texts give an empty list; every row gives one row, repeated rows too, and other
    columns are kept as they are. Whole texts are encoded. Strings of special tokens become their ids.
    """
    from pyspark.sql import types as T

    others = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*others, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    names = [f.name for f in others]
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(_encode(vocabulary, names, text, out), schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` in column ``out`` (replaced if it exists).

    A null list gives the empty text, unknown ids give nothing, and bytes that are no UTF-8 become U+FFFD.
    """
    from pyspark.sql import types as T

    others = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*others, T.StructField(out, T.StringType())])
    names = [f.name for f in others]
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(_decode(vocabulary, names, ids, out), schema)


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
