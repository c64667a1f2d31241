"""Sorted sets of whole numbers as bytes, for state that is kept between micro-batches.

Numbers are split by their high bits into containers of 65,536. A container is a sorted list of 16-bit numbers or, if
it is crowded, a bitmap of 8 kB; a set of numbers far from each other is a plain list. So a set grows with the numbers
it can hold and not with how often they came, and uniting sets is the same in any order.
"""

from __future__ import annotations

import numpy as np

_CROWDED = 4096  # numbers from which a bitmap is smaller
_PLAIN, _SPLIT = 0, 1


def pack(values: np.ndarray) -> bytes:
    """From sorted distinct numbers from 0 to 2^63 - 1."""
    if not len(values):
        return b""
    high = values >> 16
    heads = np.flatnonzero(np.diff(high, prepend=-1))
    if 12 * len(heads) + 2 * len(values) >= 8 * len(values):
        return bytes([_PLAIN]) + values.astype("<i8").tobytes()
    sizes = np.diff(heads, append=len(values))
    low = (values & 0xFFFF).astype("<u2")
    crowded = sizes >= _CROWDED
    maps = []
    for a, n in zip(heads[crowded].tolist(), sizes[crowded].tolist(), strict=True):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low[a:a + n]] = 1
        maps.append(np.packbits(bits).tobytes())
    few = low[~np.repeat(crowded, sizes)].tobytes()
    return b"".join([
        bytes([_SPLIT]), len(heads).to_bytes(4, "little"), high[heads].astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), few, *maps])


def unpack(held: bytes) -> np.ndarray:
    """The numbers of ``pack``."""
    if not held:
        return np.zeros(0, np.int64)
    if held[0] == _PLAIN:
        return np.frombuffer(held, "<i8", offset=1)
    n = int.from_bytes(held[1:5], "little")
    high, sizes = np.frombuffer(held, "<i8", n, 5), np.frombuffer(held, "<i4", n, 5 + 8 * n)
    crowded = sizes >= _CROWDED
    base, at = np.repeat(high << 16, sizes), 5 + 12 * n
    out = np.empty(len(base), np.int64)
    inside = np.repeat(crowded, sizes)
    few = int(sizes[~crowded].sum())
    out[~inside] = np.frombuffer(held, "<u2", few, at)
    if crowded.any():
        maps = np.frombuffer(held, np.uint8, offset=at + 2 * few).reshape(-1, 1 << 13)
        out[inside] = np.concatenate([np.flatnonzero(np.unpackbits(m)) for m in maps])
    return out + base


def union(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct numbers of several lists."""
    parts = [p for p in parts if len(p)]
    if len(parts) == 1:
        return np.unique(parts[0])
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
