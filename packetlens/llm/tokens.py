"""Words of text columns as numpy arrays, shared by the operators that run in Arrow tasks.

Texts are read as UTF-8 bytes straight from Arrow buffers, a few megabytes at a time, so memory
does not depend on how many rows a batch has; only a single longer text makes a longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.cumprod(out)


@dataclass
class Words:
    """Words of some rows: byte places, row number, and range of words per row."""

    data: np.ndarray      # uint8, the bytes of all rows one after another
    offsets: np.ndarray   # byte range of row i is offsets[i]:offsets[i + 1]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray     # word range of row i is first[i]:first[i + 1]

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, the same in every task."""
        return span_hashes(self.data, self.starts, self.ends)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1 of one row, joined by single spaces."""
        raw = self.data
        return b" ".join([raw[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True)])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a number array, from one pass over it."""
    n = len(data)
    up, down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows with about ``chunk_bytes`` of text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + chunk_bytes, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def is_space(data: np.ndarray) -> np.ndarray:
    """Space and the control characters from tab to carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def is_letter(data: np.ndarray) -> np.ndarray:
    """ASCII letters and digits and every byte of a longer UTF-8 sequence."""
    low = data | np.uint8(32)
    return ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes ``inside`` (default: not white space) that stay within a row."""
    inside = ~is_space(data) if inside is None else inside
    n = len(data)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | row_start[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | row_start[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values; the result has len(x) - width + 1 values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:len(x) - step], x[step:])
        done += step
    return x


def joined_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of each ``width`` consecutive word hashes, in order; len(words) - width + 1 values."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(seed))
    for k in range(width):
        total = total * _BASE + words[k:k + n]
    return mix(total)
