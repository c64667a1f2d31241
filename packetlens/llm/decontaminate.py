"""Benchmark passages inside documents, found by their word edit distance.

The CGK random walk maps edit distance to Hamming distance: a word sequence is read from its start, and
after each step the walk stays on its word or goes on, by a random bit of (step, word). Two sequences
that differ by few edits give outputs that agree at most steps. Bit sampling LSH keeps ``sampled`` steps
of the output as a key; windows the size of an item are looked up by key, in as many repetitions as
the target recall needs at the largest allowed distance (measured when the probe is built, on edited copies of
all items, for each item size by itself).
Every hit is verified by the exact edit distance.

Two bounds say which windows cannot match, so that they need not be embedded; nothing is lost by them. A
match keeps all but ``edits`` words of an item, and so at least one run of words / (edits + 1) words unchanged.
A window may start with any word, as an item's first word may be the edited one.

Items are a query set: they are read in blocks of bounded size, and each block is sent to all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens


@dataclass(frozen=True)
class Decontamination:
    """Settings: a passage leaks if at most 1 - ``similarity`` of the item's words are edited.

    Items of fewer than ``min_words`` words say nothing about a document and are not searched. The recall is measured
    on at least ``copies`` edited copies of the items of each size.
    """

    similarity: float = 0.8
    recall: float = 0.99
    sampled: int = 3
    min_words: int = 5
    size_step: float = 1.25
    seed: int = 20240229
    copies: int = 256
    block_bytes: int = 8 << 20
    chunk_bytes: int = 1 << 20

    def edits(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tokens.Words:
    """Lower-cased (ASCII) runs of letters and digits."""
    return tokens.split_words(tokens.lower_ascii(data), offsets, tokens.is_letter(data))


def walk_keys(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int, steps: np.ndarray) -> np.ndarray:
    """Keys of the sequences words[start:stop]: their walk's output at ``steps`` (ascending).

    ``words`` ends with one extra entry, 0, which stands for everything after a sequence's end.
    """
    pad = len(words) - 1
    at = starts.copy()
    keys = np.full(len(starts), np.uint64(seed))
    chosen = set(steps.tolist())
    bits = words[:0]
    for step in range(int(steps[-1]) + 1):
        if step % 64 == 0:
            bits = tokens.mix(words ^ tokens.mix(np.array([seed * 64 + step // 64 + 1], np.uint64)))
        here = np.where(at < stops, at, pad)
        if step in chosen:
            keys = tokens.mix(keys ^ words[here])
        at += ((bits[here] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
    return keys


def walk_length(words: np.ndarray, seed: int) -> int:
    """Steps that the walk spends on a sequence, at most three per word."""
    at, n = 0, len(words)
    for step in range(3 * n):
        if step % 64 == 0:
            bits = tokens.mix(words ^ tokens.mix(np.array([seed * 64 + step // 64 + 1], np.uint64)))
        at += int(bits[at] >> np.uint64(step % 64)) & 1
        if at == n:
            return step + 1
    return 3 * n


def edit_distances(item: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of the item to the best prefix of each row of ``spans``, and that prefix's length."""
    rows, width = spans.shape
    column = np.arange(width + 1, dtype=np.int32)
    now = np.broadcast_to(column, (rows, width + 1)).copy()
    for i, word in enumerate(item, 1):
        up = now + 1
        up[:, 0] = i
        np.minimum(up[:, 1:], now[:, :-1] + (spans != word), out=up[:, 1:])
        now = np.minimum.accumulate(up - column, axis=1) + column
    best = now.argmin(axis=1)
    return now[np.arange(rows), best], best


@dataclass
class _Class:
    """Items of about one size, with their keys for each repetition."""

    least: int                     # words that a match keeps at least
    reach: int                     # words that a match spans at most
    items: np.ndarray              # places in the probe
    run: int                       # consecutive words that a match keeps at least
    grams: np.ndarray              # hashes of the items' runs, sorted, with the words around a start
    back: np.ndarray
    ahead: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)


class Probe:
    """A block of items, ready to be looked for."""

    def __init__(self, ids: list, texts: list[str | None], rule: Decontamination):
        self.rule = rule
        self.ids: list = []
        self.items: list[np.ndarray] = []
        for name, text in zip(ids, texts, strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            words = words_of(data, np.array([0, len(data)])).hashes()
            if name is not None and len(words) >= max(1, rule.min_words):
                self.ids.append(name)
                self.items.append(words)
        self.vocabulary = np.unique(np.concatenate(self.items)) if self.items else np.zeros(0, np.uint64)
        self.classes: list[_Class] = []
        sizes = np.array([len(w) for w in self.items])
        low = int(sizes.min()) if len(sizes) else 0
        while len(sizes) and low <= sizes.max():
            high = max(low, int(low * rule.size_step))
            places = np.flatnonzero((sizes >= low) & (sizes <= high))
            if len(places):
                self.classes.append(self._class(places))
            low = high + 1

    def _class(self, places: np.ndarray) -> _Class:
        sizes = [len(self.items[i]) for i in places]
        edits = [self.rule.edits(n) for n in sizes]
        run = min(n // (e + 1) for n, e in zip(sizes, edits, strict=True))
        # where a text holds a run of an item, the item may start as far before it as the run's place, give or take the edits
        runs = [tokens.joined_hashes(self.items[i], run) for i in places]
        names, which = np.unique(np.concatenate(runs), return_inverse=True)
        offset = np.concatenate([np.arange(len(r)) for r in runs])
        slack = np.concatenate([np.full(len(r), e) for r, e in zip(runs, edits, strict=True)])
        back, ahead = np.zeros(len(names), np.int64), np.full(len(names), 1 << 40)
        np.maximum.at(back, which, offset + slack)
        np.minimum.at(ahead, which, offset - slack)
        found = _Class(
            min(n - e for n, e in zip(sizes, edits, strict=True)), max(n + e for n, e in zip(sizes, edits, strict=True)),
            places, run, names, back, ahead)
        flat = np.concatenate([*(self.items[i] for i in places), np.zeros(1, np.uint64)])
        stops = np.cumsum(sizes)
        starts = stops - sizes
        edited = self._edited(places)
        rng = np.random.default_rng(self.rule.seed)
        missed = np.ones(len(edited[1]))
        _, kind = np.unique(np.array(sizes)[edited[3]], return_inverse=True)
        copies = np.bincount(kind)
        repetition = 0
        # repeat until the edited copies of every size are found with the target recall
        while repetition < 4 or (np.bincount(kind, missed) > (1 - self.rule.recall) * copies).any():
            seed = self.rule.seed + 1000 * repetition + int(places[0])
            length = min(walk_length(self.items[i], seed) for i in places)
            steps = np.sort(rng.choice(length, min(self.rule.sampled, length), replace=False))
            keys = walk_keys(flat, starts, stops, seed, steps)
            order = np.argsort(keys, kind="stable")
            found.steps.append(np.r_[seed, steps])
            found.keys.append(keys[order])
            found.owners.append(places[order])
            missed *= walk_keys(edited[0], edited[1], edited[2], seed, steps) != keys[edited[3]]
            repetition += 1
        return found

    def _edited(self, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Copies of all items with as many random edits as are allowed, at any place, followed by other words."""
        rng = np.random.default_rng(self.rule.seed + 1)
        parts, starts, stops, owners, at = [], [], [], [], 0
        alike = Counter(len(self.items[i]) for i in places)
        for k, i in enumerate(places):
            for _ in range(-(-self.rule.copies // alike[len(self.items[i])])):
                words = list(self.items[i])
                for _ in range(self.rule.edits(len(words))):
                    kind, place = rng.integers(3), int(rng.integers(max(1, len(words))))
                    if kind == 0:
                        words[place:place + 1] = [rng.integers(1 << 63)]
                    elif kind == 1:  # a word before the first is outside of the passage
                        words.insert(place + 1, rng.integers(1 << 63))
                    else:
                        del words[place:place + 1]
                words += list(rng.integers(1 << 63, size=len(words)))
                parts.append(np.array(words, np.uint64))
                starts.append(at)
                at += len(words)
                stops.append(at)
                owners.append(k)
        return np.concatenate([*parts, np.zeros(1, np.uint64)]), np.array(starts), np.array(stops), np.array(owners)

    def _members(self, hashes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are among the sorted names, and their places there."""
        hint = np.zeros(1 << 18, bool)
        hint[(names >> np.uint64(46)).astype(np.int64)] = True
        maybe = np.flatnonzero(hint[(hashes >> np.uint64(46)).astype(np.int64)])
        at = np.searchsorted(names, hashes[maybe])
        at[at == len(names)] = 0
        right = names[at] == hashes[maybe]
        return maybe[right], at[right]

    def _starts(self, group: _Class, grams: np.ndarray, row_end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Words from which a match may start, by the runs that the text shares with the items."""
        at, which = self._members(grams, group.grams)
        at, which = at[row_end[at] >= at + group.run], which[row_end[at] >= at + group.run]
        row_start = first[np.searchsorted(first, at, "right") - 1]
        low = np.maximum(at - group.back[which], row_start)
        high = np.maximum(low, np.minimum(at - group.ahead[which], row_end[at] - 1) + 1)
        change = np.zeros(len(row_end) + 1, np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def search(self, words: tokens.Words) -> list[tuple[int, int, int, int, int]]:
        """(row, item place, distance, first word, end word): the nearest place of each item in each row."""
        hashes = words.hashes()
        n = len(hashes)
        if not n or not self.items:
            return []
        row_end = np.repeat(words.first[1:], np.diff(words.first))
        padded = np.append(hashes, np.uint64(0))
        grams: dict[int, np.ndarray] = {}
        kept = None
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for group in self.classes:
            if group.run not in grams:
                grams[group.run] = tokens.joined_hashes(hashes, group.run)
            at = self._starts(group, grams[group.run], row_end, words.first)
            if not len(at):
                continue
            if kept is None:
                known = np.zeros(n, bool)
                known[self._members(hashes, self.vocabulary)[0]] = True
                kept = np.concatenate([[0], np.cumsum(known)])
            stop = np.minimum(at + group.reach, row_end[at])
            enough = kept[stop] - kept[at] >= group.least
            at, stop = at[enough], stop[enough]
            if not len(at):
                continue
            # only the words of these windows are hashed anew in each repetition
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, stop, -1)
            used = np.cumsum(change[:-1]) > 0
            near = np.append(hashes[used], np.uint64(0))
            begin = (np.cumsum(used) - 1)[at]
            end = begin + stop - at
            pairs = []
            for steps, keys, owners in zip(group.steps, group.keys, group.owners, strict=True):
                found = walk_keys(near, begin, end, int(steps[0]), steps[1:])
                low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                hit = np.flatnonzero(high > low)
                times = (high - low)[hit]
                which = np.repeat(low[hit] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                pairs.append(np.repeat(hit, times) * len(self.items) + owners[which])
            for item, spots in _by_item(np.unique(np.concatenate(pairs)), len(self.items)):
                self._verify(item, at[spots], row_end, padded, words.first, best)
        return [(row, item, *x) for (row, item), x in best.items()]

    def _verify(self, item: int, at: np.ndarray, row_end: np.ndarray, padded: np.ndarray, first: np.ndarray, best: dict) -> None:
        text = self.items[item]
        most = self.rule.edits(len(text))
        span = np.arange(len(text) + most)
        for k in range(0, len(at), 20_000):
            part = at[k:k + 20_000]
            place = part[:, None] + span
            place[place >= row_end[part][:, None]] = len(padded) - 1
            distance, length = edit_distances(text, padded[place])
            for j in np.flatnonzero(distance <= most).tolist():
                row = int(np.searchsorted(first, part[j], "right")) - 1
                start = int(part[j] - first[row])
                found = (int(distance[j]), start, start + int(length[j]))
                if found < best.get((row, item), (len(text) + 1, 0, 0)):
                    best[row, item] = found


def _by_item(pairs: np.ndarray, n_items: int) -> Iterator[tuple[int, np.ndarray]]:
    if not len(pairs):
        return
    items, spots = pairs % n_items, pairs // n_items
    order = np.argsort(items, kind="stable")
    items, spots = items[order], spots[order]
    edges = np.flatnonzero(np.diff(items, prepend=-1))
    for item, group in zip(items[edges].tolist(), np.split(spots, edges[1:]), strict=True):
        yield item, group


FOUND = "doc_id long, item_id long, distance int, item_words int, start_word int, end_word int"


def _search(probe: Probe) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            found = []
            for a, _, data, offsets in tokens.chunks(batch.column("text"), probe.rule.chunk_bytes):
                for row, item, distance, start, end in probe.search(words_of(data, offsets)):
                    found.append((names[a + row], probe.ids[item], distance, len(probe.items[item]), start, end))
            if found:
                kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)],
                    ["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"])
    return run


def leaks(docs: DataFrame, items: DataFrame, rule: Decontamination = Decontamination()) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start_word, end_word) of every benchmark item found in a document.

    ``docs`` (doc_id, text) and ``items`` (item_id, text) may have other columns, which are ignored. One row
    for each row of ``docs`` and item, with the nearest place (of equally near ones the first). Null
    and empty texts hold and are nothing; items without an id are not searched; a repeated row of ``docs`` gives
    its rows again; a null doc_id stays null. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / rule.block_bytes))
    out = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        probe = Probe([r.item_id for r in rows], [r.text for r in rows], rule)
        out.append(docs.mapInArrow(_search(probe), FOUND))
    return reduce(DataFrame.unionByName, out)


def without_leaks(docs: DataFrame, items: DataFrame, rule: Decontamination = Decontamination()) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no leak; rows without doc_id stay."""
    found = leaks(docs, items, rule).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["leaked_id"], "left_anti")
