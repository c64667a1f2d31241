"""Token counts of texts from counts of their pre-tokens, without any list of ids.

1. Each task cuts its texts into pre-tokens and writes, for a few megabytes of text at a time (a chunk), the chunk's distinct
   pre-tokens in the order of a hash, and how often each document has each of them, packed to about three bytes an entry.
   The texts are read once and never shuffled.
2. Ranges of the hash are buckets. A chunk sends each bucket the distinct pre-tokens in its range, as one row. There every
   distinct pre-token of the corpus is encoded once, only to be counted, and each row gets its numbers back in order. A pre-token
   that stands in every text is one entry for each chunk. The number of buckets follows from the bytes sent.
3. Chunks join their frequencies with these numbers and sum frequency times pieces by document.

The tokenizer's file is read on the driver; its size does not depend on the data.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import workspace
from . import bpe, tokens

CHUNK_BYTES = 4 << 20  # of text behind one row of frequencies
PART_BYTES = 1 << 20   # of text cut into pre-tokens at once
BUCKET_BYTES = 8 << 20  # of pre-tokens that are counted together

CHUNKS = (
    "chunk long, doc_id array<long>, n_bytes array<long>, special array<long>, ends array<int>, "
    "gaps binary, times binary, sizes binary, names binary")


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE tokenizer file, and the strings that are always one token."""

    text: str
    special: tuple[bytes, ...]

    @staticmethod
    def load(path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        return Tokenizer(text, tuple(t["content"].encode() for t in json.loads(text).get("added_tokens", [])))


def whole_parts(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that cut no pre-token: at ends of texts, or between a letter and white space."""
    low = data | np.uint8(32)
    letter = (low >= 97) & (low <= 122)
    after = np.flatnonzero(letter[:-1] & tokens.is_space(data[1:])) + 1 if len(data) > size else np.zeros(0, np.int64)
    allowed = np.union1d(offsets, after)
    a, n = 0, len(data)
    while a < n:
        k = int(np.searchsorted(allowed, a + size, "right")) - 1
        b = int(allowed[k]) if allowed[k] > a else int(allowed[k + 1])
        yield a, b
        a = b


def special_spans(data: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...]) -> np.ndarray:
    """(start, end) of special strings, from the left and without overlaps, longer ones first; none crosses texts."""
    whole = data.tobytes()
    if not any(s in whole for s in special):
        return np.zeros((0, 2), np.int64)
    pattern = re.compile(b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
    found = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in pattern.finditer(whole, a, b)]
    return np.array(found, np.int64).reshape(-1, 2)


def piece_offsets(data: np.ndarray, offsets: np.ndarray, spans: np.ndarray, kinds: bpe.Kinds, size: int = PART_BYTES) -> np.ndarray:
    """Byte offsets at which pre-tokens start, and the end of the data."""
    edges = np.union1d(offsets, spans.reshape(-1))
    out = []
    for a, b in whole_parts(data, offsets, size):
        part = data[a:b]
        points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        mark = np.zeros(len(points) + 1, bool)
        inner = edges[np.searchsorted(edges, a):np.searchsorted(edges, b, "right")] - a
        mark[np.searchsorted(lead, inner)] = True
        mark[0] = mark[-1] = True
        out.append(lead[bpe.piece_starts(points, kinds.of(points), mark)] + a)
    return np.concatenate([*out, [len(data)]]).astype(np.int64)


def _readable(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, with bytes that are no UTF-8 replaced by U+FFFD."""
    try:
        data.tobytes().decode()
        return data, offsets
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def frequencies(data: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...], kinds: bpe.Kinds) -> tuple:
    """Special strings per text, end of each text's entries, their pre-tokens and times, and the distinct pre-tokens by hash."""
    data, offsets = _readable(data, offsets)
    spans = special_spans(data, offsets, special)
    cuts = piece_offsets(data, offsets, spans, kinds)
    named = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which, starts = named.indices.to_numpy().astype(np.int64), cuts[:-1]
    if len(spans):
        inside = np.searchsorted(spans[:, 0], starts, "right") - 1
        plain = (inside < 0) | (starts >= spans[inside, 1])
        which, starts = which[plain], starts[plain]

    def row_of(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, places, "right") - 1

    order = np.argsort(hashes(named.dictionary), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    n = max(1, len(order))
    keys, times = np.unique(row_of(starts) * n + place[which], return_counts=True)
    ends = np.searchsorted(keys, np.arange(1, len(offsets)) * n)
    return np.bincount(row_of(spans[:, 0]), minlength=len(offsets) - 1), ends, keys % n, times, named.dictionary.take(pa.array(order))


def hashes(names: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values; they only place values, and do not stand for them."""
    sizes, data = unjoined(names)
    ends = np.cumsum(sizes)
    return tokens.span_hashes(data, ends - sizes, ends)


def joined(sizes: np.ndarray, data: bytes) -> pa.Array:
    """Binary values from their sizes and their bytes one after another."""
    bounds = np.append(0, np.cumsum(sizes))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def unjoined(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    names = names.cast(pa.large_binary())
    bounds = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1]
    raw = names.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return np.diff(bounds), data


def squeezed(values: np.ndarray, kind: type = np.uint8) -> np.ndarray:
    """Numbers from 0 in the width of ``kind``; for larger ones its highest number stands before, as often as it goes in."""
    most = np.iinfo(kind).max
    before = values // most
    last = np.cumsum(before + 1)
    out = np.full(last[-1] if len(last) else 0, most, kind)
    out[last - 1] = values % most
    return out


def spread(held: np.ndarray) -> np.ndarray:
    """The numbers that ``squeezed`` took."""
    return np.diff(np.cumsum(held, dtype=np.int64)[held != np.iinfo(held.dtype).max], prepend=0)


def gaps_of(ends: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Steps between the ascending pre-tokens of each text; the first one counts from 0."""
    gap = np.diff(piece, prepend=0)
    heads = np.append(0, ends[:-1])[np.diff(ends, prepend=0) > 0]
    gap[heads] = piece[heads]
    return gap


def pieces_of(ends: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The pre-token of each entry."""
    total = np.append(0, np.cumsum(gaps))
    return total[1:] - np.repeat(total[np.append(0, ends[:-1])], np.diff(ends, prepend=0))


def _chunk_rows(special: tuple[bytes, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = bpe.Kinds()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offsets in tokens.chunks(batch.column("text"), CHUNK_BYTES):
                fixed, ends, piece, times, names = frequencies(data, offsets, special, kinds)
                sizes, letters = unjoined(names)
                lists = [
                    batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.array(fixed, pa.int64()),
                    pa.array(ends, pa.int32())]
                held = [squeezed(gaps_of(ends, piece), np.uint16), squeezed(times), squeezed(sizes), letters]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists],
                     *[pa.array([x.tobytes()], pa.binary()) for x in held]],
                    ["chunk", "doc_id", "n_bytes", "special", "ends", "gaps", "times", "sizes", "names"])
                number += 1
    return run


def _bucket_rows(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, names in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "names")), strict=True):
                sizes = spread(np.frombuffer(sizes, np.uint8))
                place = ((hashes(joined(sizes, names)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                edges, ends = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64)), np.append(0, np.cumsum(sizes))
                full = np.flatnonzero(np.diff(edges))
                spans = list(zip(edges[full].tolist(), edges[full + 1].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array(np.full(len(full), chunk), pa.int64()),
                     pa.array([squeezed(sizes[a:b]).tobytes() for a, b in spans], pa.binary()),
                     pa.array([names[ends[a]:ends[b]] for a, b in spans], pa.binary())], ["bucket", "chunk", "sizes", "names"])
    return run


@functools.lru_cache(maxsize=1)
def _model(text: str):
    from tokenizers import Tokenizer as Library

    return Library.from_str(text).model


def _answers(text: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        model = _model(text)
        shown = dict(enumerate(bpe.byte_characters()))
        sizes = [spread(np.frombuffer(x, np.uint8)) for x in table.column("sizes").to_pylist()]
        held = joined(np.concatenate(sizes), b"".join(table.column("names").to_pylist())).dictionary_encode()
        n = np.array([len(model.tokenize(p.decode("latin-1").translate(shown))) for p in held.dictionary.to_pylist()], np.int64)
        parts = np.split(n[held.indices.to_numpy()], np.cumsum([len(x) for x in sizes])[:-1])
        return pa.table({
            "chunk": table.column("chunk"), "bucket": table.column("bucket"),
            "n": pa.array([squeezed(x).tobytes() for x in parts], pa.binary())})
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            ids, sizes, fixed, ends, counts = (batch.column(c).slice(k, 1).flatten() for c in ("doc_id", "n_bytes", "special", "ends", "counts"))
            gaps, times = (spread(np.frombuffer(batch.column(c)[k].as_py(), t)) for c, t in (("gaps", np.uint16), ("times", np.uint8)))
            ends = ends.to_numpy()
            order = np.argsort(counts.field("bucket").to_numpy()) if len(counts) else []
            parts = counts.field("n").to_pylist() if len(counts) else []
            n = spread(np.frombuffer(b"".join([parts[i] for i in order]), np.uint8))
            total = np.append(0, np.cumsum(n[pieces_of(ends, gaps)] * times))
            n = np.diff(total[np.append(0, ends)]) + fixed.to_numpy()
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text; other columns are ignored).

    n_bytes counts UTF-8 bytes. Null and empty texts have 0 of both; repeated rows and null ids are counted like any
    other row; an empty table gives no rows. Whole texts are counted; a long one is cut into parts between a letter and
    white space, where no pre-token can go across. Special strings count one token each. Pre-tokens are compared whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = workspace.fresh(docs.sparkSession, "token_chunks")
    rows.mapInArrow(_chunk_rows(tokenizer.special), CHUNKS).write.option("compression", "zstd").parquet(path)
    chunks = docs.sparkSession.read.schema(CHUNKS).parquet(path)
    sent = chunks.agg(F.sum(F.octet_length("names") + F.octet_length("sizes"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sent // BUCKET_BYTES))
    asked = chunks.select("chunk", "sizes", "names").mapInArrow(_bucket_rows(buckets), "bucket int, chunk long, sizes binary, names binary")
    told = asked.groupBy("bucket").applyInArrow(_answers(tokenizer.text), "chunk long, bucket int, n binary")
    counts = told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    none = F.array().cast("array<struct<bucket:int,n:binary>>")
    whole = chunks.drop("sizes", "names").join(counts, "chunk", "left").withColumn("counts", F.coalesce("counts", none))
    return whole.mapInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
