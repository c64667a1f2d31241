"""Removal of word passages that occur more than once, by super-k-mer partitioning.

A window is ``window`` consecutive words of one text. Its minimiser is the smallest hash of ``seed``
consecutive words inside it; consecutive windows with the same minimiser form a super-k-mer, which
travels as one packed string to the bucket of its minimiser. Equal windows have equal minimisers, so
each bucket can sort and count its windows on its own.

1. ``_minimisers`` counts how often each minimiser occurs in the corpus (pre-aggregated per batch). A
   super-k-mer whose minimiser occurs once cannot hold a repeated window, so it need not travel.
2. The other super-k-mers are packed, equal strings of a batch as one row, and dealt by minimiser. A
   bucket ranks its windows by sorting and returns the word ranges of those that occur twice or more.
   The windows of a minimiser with more than ``hot`` occurrences travel one by one instead, dealt by
   their own content: equal ones merge per batch, so no bucket holds more than ``hot`` strings.
3. Places of strings are joined with the ranges found (a join that adaptive execution splits where a
   string is very common), and the ranges go back to their texts, which lose the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import workspace
from . import tokens


@dataclass(frozen=True)
class Repeats:
    """Settings: a window has ``window`` words, a minimiser ``seed`` words."""

    window: int = 35
    seed: int = 6
    hot: int = 20_000
    chunk_bytes: int = 1 << 20


def minimisers(hashes: np.ndarray, first: np.ndarray, rule: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes at each word, and the least of the window that starts there (0 where no window does)."""
    w, m = rule.window, rule.seed
    seeds = tokens.joined_hashes(hashes, m, seed=m)
    if len(hashes) < w:
        return seeds, np.zeros(0, np.uint64)
    least = np.maximum(tokens.sliding_min(seeds, w - m + 1), np.uint64(1))
    row_end = np.repeat(first[1:], np.diff(first))[:len(least)]
    least[np.arange(len(least)) + w > row_end] = 0
    return seeds, least


def chosen_seeds(seeds: np.ndarray, least: np.ndarray, rule: Repeats) -> np.ndarray:
    """Hashes of all places that are the minimiser of a window over them, one for each place.

    Equal windows at two places have two such places with the same hash.
    """
    reach = rule.window - rule.seed
    edge = np.zeros(reach, np.uint64)
    over = ~tokens.sliding_min(~np.concatenate([edge, least, edge]), reach + 1)  # the largest minimiser of the windows over a place
    return seeds[(np.maximum(seeds, np.uint64(1)) == over) & (over > 0)]


def super_kmers(least: np.ndarray, first: np.ndarray, rule: Repeats) -> tuple[np.ndarray, ...]:
    """(row, first word, end word, minimiser) of the super-k-mers of some texts."""
    whole = least > 0
    starts_row = np.zeros(len(least) + 1, bool)
    starts_row[first[first <= len(least)]] = True
    new = whole.copy()
    new[1:] &= (least[1:] != least[:-1]) | starts_row[1:-1]
    start = np.flatnonzero(new)
    sums = np.concatenate([[0], np.cumsum(whole)])
    end = start + (sums[np.append(start[1:], len(least))] - sums[start]) + rule.window - 1 if len(start) else start
    row = np.searchsorted(first, start, "right") - 1
    return row, start - first[row], end - first[row], least[start]


def _long(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _each(batch: pa.RecordBatch, rule: Repeats) -> Iterator[tuple]:
    for a, _, data, offsets in tokens.chunks(batch.column("text"), rule.chunk_bytes):
        words = tokens.split_words(data, offsets)
        yield a, words.first, *minimisers(words.hashes(), words.first, rule)


COUNTS = "minimiser long, times long"
PLACES = "minimiser long, k1 long, k2 long, start int, stop int"


def _minimisers(rule: Repeats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chosen_seeds(seeds, least, rule) for _, _, seeds, least in _each(batch, rule)]
            name, times = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            if len(name):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_long(np.maximum(name, np.uint64(1)))), pa.array(times.astype(np.int64))], ["minimiser", "times"])
    return run


def _places(rule: Repeats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for a, first, _, least in _each(batch, rule):
                row, start, stop, value = super_kmers(least, first, rule)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_long(value)), pa.array(k1[a + row]), pa.array(k2[a + row]),
                         pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
                        ["minimiser", "k1", "k2", "start", "stop"])
    return run


def _texts(batch: pa.RecordBatch, rule: Repeats) -> Iterator[tuple[int, list[bytes]]]:
    """(row, words); splitting bytes parts them at the same characters."""
    for a, _, data, offsets in tokens.chunks(batch.column("text"), rule.chunk_bytes):
        raw = data.tobytes()
        for k, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            yield a + k, raw[s:e].split()


STRINGS = "name long, digest long, packed binary, copies long"
STRING_PLACES = "name long, digest long, k1 long, k2 long, start int"
RANGES = "name long, digest long, ranges array<struct<start:int,stop:int>>"


def _spell(batch: pa.RecordBatch, rule: Repeats) -> Iterator[tuple]:
    """(row, first word, name, digest, packed string) of the chosen super-k-mers, or of their windows where these are hot."""
    chosen = batch.column("chosen").to_pylist()
    for row, spelled in _texts(batch, rule):
        for pick in chosen[row]:
            if not pick["hot"]:
                text = b" ".join(spelled[pick["start"]:pick["stop"]])
                digest = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                yield row, pick["start"], pick["minimiser"], digest, text
                continue
            for start in range(pick["start"], pick["stop"] - rule.window + 1):
                text = b" ".join(spelled[start:start + rule.window])
                both = hashlib.blake2b(text, digest_size=16).digest()
                yield row, start, *(int.from_bytes(x, "little", signed=True) for x in (both[:8], both[8:])), text


def _strings(rule: Repeats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int, bytes], int] = {}
            for _, _, *key in _spell(batch, rule):
                key = tuple(key)
                found[key] = found.get(key, 0) + 1
            if found:
                columns = [*zip(*found, strict=True), list(found.values())]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "digest", "packed", "copies"])
    return run


def _string_places(rule: Repeats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            found = [x[:4] for x in _spell(batch, rule)]
            if found:
                row, start, name, digest = (np.array(c, np.int64) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (name, digest, k1[row], k2[row], start.astype(np.int32))],
                    ["name", "digest", "k1", "k2", "start"])
    return run


def repeated_ranges(packed: list[bytes], copies: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Word ranges of each string covered by windows that occur twice or more in all strings.

    ``copies``: how often each string itself occurs. Windows are ranked by sorting: ranks of one word,
    then of 2, 4, ... words from pairs of ranks, until the window's width; equal ranks are equal words.
    """
    spelled = [p.split(b" ") for p in packed]
    sizes = np.array([len(s) for s in spelled])
    names: dict[bytes, int] = {}
    rank = np.array([names.setdefault(w, len(names)) for s in spelled for w in s], np.int64)
    width = 1
    while width < window:
        step = min(width, window - width)
        # ranks reach over string ends here; such windows are left out below
        pair = rank[:len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        width += step
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(packed)), sizes)[:len(rank)]
    whole = np.flatnonzero(np.arange(len(rank)) + window <= (first + sizes)[owner])
    times = np.bincount(rank[whole], np.asarray(copies)[owner[whole]])
    out: list[list[tuple[int, int]]] = [[] for _ in packed]
    for at in whole[times[rank[whole]] > 1].tolist():
        mine = out[owner[at]]
        start = at - int(first[owner[at]])
        if mine and mine[-1][1] >= start:
            mine[-1] = (mine[-1][0], start + window)
        else:
            mine.append((start, start + window))
    return out


def _count(rule: Repeats) -> Callable:
    """From rows sorted by name and digest: ranges of the strings that hold repeated windows."""
    def solve(rows: list[list]) -> list[tuple]:
        """Of whole buckets; equal windows are always in one bucket, so many are ranked together."""
        out, hard = [], []
        for k, (name, digest, text, copies) in enumerate(rows):
            alone = (k == 0 or rows[k - 1][0] != name) and (k + 1 == len(rows) or rows[k + 1][0] != name)
            if alone and copies > 1:  # every window occurs as often as the string
                out.append((name, digest, [{"start": 0, "stop": text.count(b" ") + 1}]))
            else:
                hard.append(rows[k])
        if hard:
            ranges = repeated_ranges([r[2] for r in hard], [r[3] for r in hard], rule.window)
            out += [(r[0], r[1], [{"start": s, "stop": e} for s, e in x]) for r, x in zip(hard, ranges, strict=True) if x]
        return out

    def ready(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["name", "digest", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for batch in batches:
            for name, digest, text, copies in zip(*(batch.column(c).to_pylist() for c in ("name", "digest", "packed", "copies")), strict=True):
                if rows and rows[-1][0] == name and rows[-1][1] == digest and rows[-1][2] == text:
                    rows[-1][3] += copies
                    continue
                if len(rows) >= 2_000 and rows[-1][0] != name:
                    if out := solve(rows):
                        yield ready(out)
                    rows = []
                rows.append([name, digest, text, copies])
        if out := solve(rows):
            yield ready(out)
    return run


def _keep(rule: Repeats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column("ranges").to_pylist()
            total, removed, kept = [], [], []
            for row, spelled in _texts(batch, rule):
                out, at = [], 0
                for s, e in sorted((r["start"], r["stop"]) for r in ranges[row] or ()):
                    out += spelled[at:s] if s > at else []
                    at = max(at, e)
                out = out + spelled[at:] if at else spelled
                total.append(len(spelled))
                removed.append(len(spelled) - len(out))
                kept.append(b" ".join(out).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def drop_repeats(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs`` (doc_id, text; others are ignored).

    A word goes if any window over it starts a word sequence that also starts elsewhere in the table,
    the same text included; windows are judged on the input. Kept words are joined by one space.
    Null and empty texts have no words; texts shorter than a window lose none. Rows repeated as a whole are
    occurrences like any other. A null doc_id stays null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    workspace.root(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # equal keys mean equal rows, which share their result
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"))
    live = (
        docs.select("text").mapInArrow(_minimisers(rule), COUNTS).groupBy("minimiser").agg(F.sum("times").alias("n")).where("n > 1")
        .select("minimiser", (F.col("n") > rule.hot).alias("hot")))
    places = docs.select("text", "k1", "k2").mapInArrow(_places(rule), PLACES).join(live, "minimiser")
    chosen = places.groupBy("k1", "k2").agg(F.collect_set(F.struct("minimiser", "start", "stop", "hot")).alias("chosen"))
    # all columns of docs are kept, so that Spark sees that the shuffle of the texts is the one needed again below
    picked = docs.join(chosen, ["k1", "k2"])
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strings = picked.mapInArrow(_strings(rule), STRINGS)
    ranges = strings.repartition(width, "name").sortWithinPartitions("name", "digest").mapInArrow(_count(rule), RANGES)
    spots = picked.mapInArrow(_string_places(rule), STRING_PLACES).join(ranges, ["name", "digest"])
    spots = spots.select("k1", "k2", F.explode(F.transform("ranges", lambda r: F.struct(
        (r["start"] + F.col("start")).alias("start"), (r["stop"] + F.col("start")).alias("stop")))).alias("range"))
    by_text = spots.groupBy("k1", "k2").agg(F.collect_set("range").alias("ranges"))
    out = docs.join(by_text, ["k1", "k2"], "left")
    return out.mapInArrow(_keep(rule), "doc_id long, n_words long, n_removed long, kept_text string")
