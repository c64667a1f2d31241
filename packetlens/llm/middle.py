"""Fill-in-the-middle: texts are cut twice and their middle is moved to the end.

Where a text may be cut is a set of byte offsets, kept as a Roaring-style set: offsets are split by their high
bits into containers of 65,536 values, each a sorted array, a bitmap or a list of runs, whichever is smallest.
Cumulative cardinalities of the containers lead to the one that holds the k-th offset; a select inside it gives its place.
So a cut after k units of a text needs neither decoding nor a pass over its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

CONTAINER = 1 << 16
WORD_BITS = 64


@dataclass(frozen=True)
class ArrayContainer:
    """Few values: a sorted array of 16-bit numbers."""

    values: np.ndarray

    def __len__(self) -> int:
        return len(self.values)

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass(frozen=True)
class BitmapContainer:
    """Many scattered values: 65,536 bits and the number of values before each 64-bit word."""

    words: np.ndarray
    before: np.ndarray

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[at:at + 1].view(np.uint8), bitorder="little")
        return at * WORD_BITS + int(np.flatnonzero(bits)[k - int(self.before[at])])


@dataclass(frozen=True)
class RunContainer:
    """Values in runs: first values and the number of values before each run."""

    first: np.ndarray
    before: np.ndarray

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted distinct values below 65,536."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    runs, n = len(breaks) + 1, len(low)
    if 4 * runs < min(2 * n, CONTAINER // 8):
        heads = np.concatenate([[0], breaks])
        return RunContainer(low[heads], np.append(heads, n))
    if 2 * n <= CONTAINER // 8:
        return ArrayContainer(low.astype(np.uint16))
    bits = np.zeros(CONTAINER, np.uint8)
    bits[low] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    return BitmapContainer(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))


@dataclass(frozen=True)
class BoundarySet:
    """A set of byte offsets with select."""

    high: np.ndarray     # number of each container, ascending
    before: np.ndarray   # values before each container; one longer
    parts: list

    @staticmethod
    def of(offsets: np.ndarray) -> BoundarySet:
        """From sorted distinct offsets."""
        high = offsets >> 16
        heads = np.flatnonzero(np.diff(high, prepend=-1))
        edges = np.append(heads, len(offsets))
        parts = [container(offsets[a:b] & (CONTAINER - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return BoundarySet(high[heads], edges, parts)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.high[at]) << 16) + self.parts[at].select(k - int(self.before[at]))


@dataclass(frozen=True)
class FillInMiddle:
    """Settings. ``unit``: cuts fall between code points ("char") or before words ("word").

    Of 100 texts about ``percent`` are rearranged, of those ``suffix_first`` in 100 in the order suffix, prefix, middle.
    Draws are the groups of a SHA-256 of ``salt`` and the row's key.
    """

    unit: str = "char"
    percent: int = 90
    suffix_first: int = 20
    salt: str = "1:"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if any(not m or any(m[0] in other[1:] for other in self.marks) for m in self.marks) or len(set(self.marks)) < 3:
            raise ValueError("marks must differ, and no mark may hold the first character of one behind its own first place")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def cut_places(data: np.ndarray, unit: str) -> np.ndarray:
    """Byte offsets of one UTF-8 text where it may be cut; its end is the last."""
    if unit == "char":
        inside = (data & 0xC0) != 0x80
    elif unit == "word":
        inside = ~tokens.is_space(data)
        inside[1:] &= tokens.is_space(data[:-1])
    else:
        raise ValueError(f"unit {unit!r}")
    places = np.flatnonzero(inside)
    return np.append(places, len(data)) if len(data) else places


def draws(key: Column, rule: FillInMiddle) -> list[Column]:
    """The first four 32-bit groups of the hash of a row's key; a null key counts as the empty string."""
    hexed = F.sha2(F.concat(F.lit(rule.salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _arranged(rule: FillInMiddle, names: list[str], added: list[str]) -> Callable:
    p, s, m = (x.encode() for x in rule.marks)

    def one(data: np.ndarray, h: tuple) -> tuple:
        raw = data.tobytes()
        places = cut_places(data, rule.unit)
        n = max(0, len(places) - 1)
        if not raw or any(x in raw for x in (p, s, m)) or h[2] % 100 >= rule.percent:
            return n, "plain", None, None, raw
        allowed = BoundarySet.of(places)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        i, j = allowed.select(a), allowed.select(b)
        if rule.unit == "word" and a == 0:  # white space before the first word goes with it
            i, j = 0, (0 if b == 0 else j)
        if h[3] % 100 < rule.suffix_first:
            return n, "spm", a, b - a, s + raw[j:] + p + raw[:i] + m + raw[i:j]
        return n, "psm", a, b - a, p + raw[:i] + s + raw[j:] + m + raw[i:j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = list(zip(*(batch.column(f"__h{k}").to_pylist() for k in range(4)), strict=True))
            for a, b, data, offsets in tokens.chunks(batch.column("__text")):
                rows = [one(data[x:y], h) for x, y, h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), drawn[a:b], strict=True)]
                n, form, before, between, out = zip(*rows, strict=True)
                kept = [batch.column(f"__own{k}").slice(a, b - a) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(between, pa.int64()),
                     pa.array(out, pa.binary()).view(pa.string())], [*names, *added])
    return run


ADDED = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()),
    T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType())]


def fill_in_middle(docs: DataFrame, rule: FillInMiddle = FillInMiddle(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units of the text), form, prefix_units, middle_units and output; columns of these names are replaced.

    A text is plain (output is the text itself, prefix_units and middle_units null) if it is empty or null, holds one of the
    marks, or is not drawn. Every row gives one row, repeated rows the same one; rows with a null key are drawn as for an empty
    key. Whole texts are rearranged, of any length; an empty table gives no rows. There is no shuffle.
    With unit "word", white space before the first word belongs to it.
    """
    new = {f.name for f in ADDED}
    others = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in others]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__own{k}") for k, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("__text"),
        *[h.alias(f"__h{k}") for k, h in enumerate(draws(F.col(f"`{key}`"), rule))])
    return rows.mapInArrow(_arranged(rule, names, [f.name for f in ADDED]), T.StructType([*others, *ADDED]))


def restored(output: Column, form: Column, rule: FillInMiddle = FillInMiddle()) -> Column:
    """The text that ``fill_in_middle`` took, from its output and form alone."""
    def parts(opening: str, between: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(opening) + 1))
        tail = F.substring_index(body, between, -1)
        return F.substring_index(body, between, 1), F.substring_index(tail, rule.middle, 1), F.substring_index(tail, rule.middle, -1)

    prefix, suffix, middle = parts(rule.prefix, rule.suffix)
    found = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(rule.suffix, rule.prefix)
    return F.when(form == "plain", output).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(found)
