"""Spelling variants: words one edit apart, and the far more frequent word that each may be a variant of.

Words are points: how often each letter stands in them. An edit moves a point by one letter more, one letter fewer, or
both, so near words lie within L1 distance two. For each length there is a k-d tree over the points of its words; words of
the same length search it with room for one letter more and one fewer, words one letter shorter with room for one letter
more, and boxes out of reach are pruned. What is left is verified by the order of the letters.

The top of a length's tree is cut from a bounded sample and deals the words to cells, one group of rows each: a word goes to its
own cell to be found, and as a query to the other cells within its reach. Inside a cell a task builds the rest of the tree.
A length with few words is one cell. All words are indexed and all search; the sample only decides where cells end.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import workspace
from . import tokens

CHUNK_BYTES = 8 << 20
#: Letters: a to z, and the code points from U+00C0 to U+00FF.
LETTERS = 26 + 64
HOME, SAME, SHORTER = range(3)
_HASHES = 1 << 20


@dataclass(frozen=True)
class Spelling:
    """Settings. Words have ``least_chars`` letters and occur ``least_times``; a form is ``ratio`` times as frequent.

    ``drop_every``: a run of letters in a document loses a letter if this divides the CRC-32 of both (0: none does).
    Cells hold about ``cell_words`` words or ``cell_chars`` letters; their cuts come from about ``sample_words`` words
    of the whole table, at least ``least_sample`` a cell, so cells grow beyond sample_words / least_sample of them.
    """

    least_chars: int = 7
    least_times: int = 2
    ratio: int = 10
    drop_every: int = 0
    cell_words: int = 1 << 14
    cell_chars: int = 1 << 25
    sample_words: int = 60_000
    least_sample: int = 16
    leaf: int = 32


# words of texts

def runs(data: np.ndarray, offsets: np.ndarray) -> tokens.Words:
    """Maximal runs of letters, A to Z in lower case."""
    low = data | np.uint8(32)
    lead = data == 0xC3
    inside = ((low >= 97) & (low <= 122)) | lead
    inside[1:] |= lead[:-1]
    return tokens.split_words(tokens.lower_ascii(data), offsets, inside)


def _dropped(word: bytes, draw: int) -> str:
    letters = word.decode()
    at = draw % len(letters)
    return letters[:at] + letters[at + 1:]


def _tally(ids: list, data: np.ndarray, offsets: np.ndarray, rule: Spelling) -> dict[str, int]:
    """How often each word stands in some texts."""
    found = runs(data, offsets)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    long = np.flatnonzero(points[found.ends] - points[found.starts] >= rule.least_chars)
    if not len(long):
        return {}
    starts, sizes = found.starts[long], found.ends[long] - found.starts[long]
    bounds = np.append(0, np.cumsum(sizes))
    flat = found.data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
    named = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(long), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
    names, which = named.dictionary.to_pylist(), named.indices.to_numpy().astype(np.int64)
    keys, times = np.unique((np.searchsorted(offsets, starts, "right") - 1) * len(names) + which, return_counts=True)
    row, which = keys // len(names), keys % len(names)
    out: dict[str, int] = {}
    if rule.drop_every:
        before = [zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids]
        drawn = np.fromiter(map(zlib.crc32, map(names.__getitem__, which.tolist()), map(before.__getitem__, row.tolist())), np.int64, len(row))
        hit = drawn % rule.drop_every == 0
        for w, h, n in zip(which[hit].tolist(), drawn[hit].tolist(), times[hit].tolist(), strict=True):
            word = _dropped(names[w], h)
            if len(word) >= rule.least_chars:
                out[word] = out.get(word, 0) + n
        which, times = which[~hit], times[~hit]
    total = np.bincount(which, times, len(names)).astype(np.int64)
    for w in np.flatnonzero(total).tolist():
        word = names[w].decode()
        out[word] = out.get(word, 0) + int(total[w])
    return out


def _word_rows(rule: Spelling) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in tokens.chunks(batch.column("text"), CHUNK_BYTES):
                found = _tally(ids[a:b], data, offsets, rule)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
    return run


def word_counts(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """(word, n) of the texts of ``docs``, counted per chunk of text before the shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_word_rows(rule), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= rule.least_times)


# points and trees

def letter_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each letter of all words (its code point), and the end of each word."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    lead = data == 0xC3
    codes = data.copy()
    codes[1:][lead[:-1]] += 0x40
    return codes[~lead], (offsets - offsets[0] - np.append(0, np.cumsum(lead))[offsets - offsets[0]])[1:]


def points_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letter counts of words, at most 255 each: cutting them off brings points nearer, so nothing is pruned by it."""
    place = np.where(codes < 128, codes.astype(np.int64) - 97, codes.astype(np.int64) - 0xC0 + 26)
    out = np.zeros((len(ends), LETTERS), np.uint8)
    step = max(1, (1 << 22) // LETTERS)
    for a in range(0, len(ends), step):
        b = min(len(ends), a + step)
        s, e = (ends[a - 1] if a else 0), ends[b - 1]
        row = np.repeat(np.arange(b - a), np.diff(ends[a:b], prepend=s))
        out[a:b] = np.minimum(np.bincount(row * LETTERS + place[s:e], minlength=(b - a) * LETTERS).reshape(-1, LETTERS), 255)
    return out


@dataclass(frozen=True)
class KdTree:
    """Nodes: points with ``letter`` at most ``cut`` times go left. A leaf has letter -1 and its number in ``left``."""

    letter: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    leaves: list[np.ndarray]

    @staticmethod
    def of(points: np.ndarray, leaf: int) -> KdTree:
        """Over the rows of ``points``; leaves have at most ``leaf`` rows, or equal ones."""
        tree = KdTree([], [], [], [], [])
        open_: list[tuple[np.ndarray, list[int] | None, int]] = [(np.arange(len(points)), None, 0)]
        while open_:
            rows, side, parent = open_.pop()
            node = len(tree.letter)
            if side is not None:
                side[parent] = node
            inside = points[rows]
            spread = inside.astype(np.float32).var(axis=0) if len(rows) > leaf else np.zeros(1)
            if not spread.max(initial=0) > 0:
                tree.letter.append(-1)
                tree.cut.append(0)
                tree.left.append(len(tree.leaves))
                tree.right.append(-1)
                tree.leaves.append(rows)
                continue
            letter = int(spread.argmax())
            values = inside[:, letter]
            cut = int(np.median(values))
            if values.max() <= cut:
                cut = int(values[values < values.max()].max())
            tree.letter.append(letter)
            tree.cut.append(cut)
            tree.left.append(-1)
            tree.right.append(-1)
            low = values <= cut
            open_ += [(rows[low], tree.left, node), (rows[~low], tree.right, node)]
        return tree

    def reach(self, points: np.ndarray, fewer: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``points``) for leaves that may hold a point with one letter more and, if ``fewer``, one fewer, or the same."""
        n = len(points)
        none = np.full(n, -1, np.int16)
        open_ = [(0, np.arange(n), none, none if fewer else np.full(n, LETTERS, np.int16))]
        while open_:
            node, rows, more, less = open_.pop()
            letter, cut = self.letter[node], self.cut[node]
            if not len(rows):
                continue
            if letter < 0:
                yield self.left[node], rows
                continue
            value = points[rows, letter].astype(np.int16) + (more == letter) - (less == letter)
            low = value <= cut
            down = (value == cut + 1) & (less < 0) & (more != letter)
            up = (value == cut) & (more < 0) & (less != letter)
            moved = np.full(1, letter, np.int16)
            open_.append((self.left[node], np.concatenate([rows[low], rows[down]]), np.concatenate([more[low], more[down]]),
                          np.concatenate([less[low], np.repeat(moved, int(down.sum()))])))
            open_.append((self.right[node], np.concatenate([rows[~low], rows[up]]),
                          np.concatenate([more[~low], np.repeat(moved, int(up.sum()))]), np.concatenate([less[~low], less[up]])))


# near words of one cell

def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two letter matrices differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long`` are the row of ``short`` with one letter put in."""
    n = short.shape[1]
    same, shifted = short == long[:, :n], short == long[:, 1:]
    head = np.where(same.all(axis=1), n, same.argmin(axis=1))
    tail = np.where(shifted.all(axis=1), n, shifted[:, ::-1].argmin(axis=1))
    return head + tail >= n


def _close(tree: KdTree, index: np.ndarray, queries: np.ndarray, fewer: bool, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``queries``, row of ``index``) of which one may be one edit from the other, by letter counts."""
    for leaf, rows in tree.reach(queries, fewer):
        held = tree.leaves[leaf]
        step = max(1, (1 << 23) // (len(held) * index.shape[1]))
        for a in range(0, len(rows), step):
            part = rows[a:a + step]
            x, y = queries[part][:, None, :].astype(np.int16), index[held][None, :, :].astype(np.int16)
            apart = np.abs(x - y).sum(axis=2)
            close = apart <= (2 if fewer else 1)
            if fewer and length <= 255:  # the same letters in another order are no single edit
                close &= apart > 0
            i, j = np.nonzero(close)
            if len(i):
                yield part[i], held[j]


def near_in_cell(words: pa.Array, role: np.ndarray, rule: Spelling) -> np.ndarray:
    """Pairs of rows (smaller word or shorter one, the other), the second of them at home in the cell."""
    codes, ends = letter_codes(words)
    begin = np.append(0, ends[:-1])
    counts = points_of(codes, ends)
    home = np.flatnonzero(role == HOME)
    if not len(home):
        return np.zeros((0, 2), np.int64)
    counts = counts[:, counts.any(axis=0)]
    tree = KdTree.of(counts[home], rule.leaf)
    length = int(ends[home[0]] - begin[home[0]])
    out = []
    for asked, fewer in ((np.flatnonzero(role != SHORTER), True), (np.flatnonzero(role == SHORTER), False)):
        if not len(asked):
            continue
        width = length if fewer else length - 1
        for i, j in _close(tree, counts[home], counts[asked], fewer, length):
            q, x = asked[i], home[j]
            step = max(1, (1 << 22) // max(1, length))
            for a in range(0, len(q), step):
                s, t = q[a:a + step], x[a:a + step]
                short, long = codes[begin[s][:, None] + np.arange(width)], codes[begin[t][:, None] + np.arange(length)]
                good = replaced(short, long) if fewer else inserted(short, long)
                if fewer and good.any():  # each pair once: from the smaller word
                    at = (short != long).argmax(axis=1)
                    good &= short[np.arange(len(s)), at] < long[np.arange(len(s)), at]
                if good.any():
                    out.append(np.stack([s[good], t[good]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _solve(rule: Spelling) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pairs = near_in_cell(table.column("word"), table.column("role").to_numpy(), rule)
        a, b = (table.take(pa.array(pairs[:, k])) for k in (0, 1))
        return pa.table({"a": a.column("word"), "a_n": a.column("n"), "b": b.column("word"), "b_n": b.column("n")})
    return run


# cells

def cell_trees(words: DataFrame, rule: Spelling) -> dict[int, KdTree]:
    """The top of the tree of every length that needs several cells."""
    length = F.char_length("word").cast("long")
    sizes = words.groupBy(length.alias("length")).agg(F.count("*").alias("rows")).withColumn(
        "cells", F.ceil(F.greatest(F.col("rows") / rule.cell_words, F.col("rows") * F.col("length") / rule.cell_chars)))
    large = {r.length: (r.rows, r.cells) for r in sizes.where("cells > 1").collect()}
    if not large:
        return {}
    share = min(1.0, rule.sample_words / sum(n for n, _ in large.values()))
    drawn = words.where(length.isin(list(large)) & (F.pmod(F.xxhash64("word"), F.lit(_HASHES)) < int(share * _HASHES)))
    held = drawn.select("word", length.alias("length")).orderBy("word").toArrow()
    out = {}
    for n, (rows, cells) in large.items():
        some = held.filter(pc.equal(held.column("length"), n)).column("word")
        if len(some) > 1:
            tree = KdTree.of(points_of(*letter_codes(some)), max(rule.least_sample, int(len(some) / cells)))
            out[n] = KdTree(tree.letter, tree.cut, tree.left, tree.right, [])  # without the sample
    return out


CELLS = "length long, cell int, role byte, word string, n long"


def _dealt(trees: dict[int, KdTree]) -> Callable:
    def places(points: np.ndarray, length: int, role: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells): where words are at home, or where they have to search."""
        if length not in trees:
            return np.arange(len(points)), np.zeros(len(points), np.int64)
        tree = trees[length]
        if role == HOME:
            found = []
            open_ = [(0, np.arange(len(points)))]
            while open_:
                node, rows = open_.pop()
                if tree.letter[node] < 0:
                    found.append((rows, np.full(len(rows), tree.left[node])))
                    continue
                low = points[rows, tree.letter[node]] <= tree.cut[node]
                open_ += [(tree.left[node], rows[low]), (tree.right[node], rows[~low])]
        else:
            found = [(rows, np.full(len(rows), leaf)) for leaf, rows in tree.reach(points, role == SAME)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = letter_codes(batch.column("word"))
            counts = points_of(codes, ends)
            lengths = np.diff(ends, prepend=0)
            for n in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == n)
                home = np.zeros(len(mine), np.int64)
                for role, of in ((HOME, n), (SAME, n), (SHORTER, n + 1)):
                    if role == SAME and n not in trees:
                        continue
                    rows, cells = places(counts[mine], of, role)
                    if role == HOME:
                        home[rows] = cells
                    elif role == SAME:
                        away = cells != home[rows]
                        rows, cells = rows[away], cells[away]
                    if len(rows):
                        part = batch.take(pa.array(mine[rows]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), of), pa.int64()), pa.array(cells, pa.int32()),
                             pa.array(np.full(len(rows), role), pa.int8()), part.column("word"), part.column("n")],
                            ["length", "cell", "role", "word", "n"])
    return run


def near_words(words: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """(a, a_n, b, b_n) for all pairs of ``words`` (word, n; distinct runs of letters) one edit apart, each once.

    The words must be lower-case letters of ``LETTERS``, as ``word_counts`` gives them; an empty table gives no pairs.
    """
    placed = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_dealt(cell_trees(words, rule)), CELLS)
    return placed.groupBy("length", "cell").applyInArrow(_solve(rule), "a string, a_n long, b string, b_n long")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where following forms ends. Each round doubles the steps taken."""
    now = workspace.written(steps.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = workspace.written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling_roots")


def variants(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of ``docs`` (doc_id, text; other columns are ignored).

    n: occurrences in all texts; n_near: words one edit apart; form: the most frequent of them (ties: the smallest in
    code-point order) if it is ``ratio`` times as frequent, else null; root: where following forms ends, the word itself
    without a form. Null and empty texts have no words; repeated rows count again; a null doc_id counts as an empty one
    where letters are dropped. Words of any length take part. An empty table gives no rows.
    """
    words = workspace.written(word_counts(docs, rule), "spelling_words")
    near = workspace.written(near_words(words, rule), "spelling_near")
    both = near.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        near.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other"))).alias("best"))
    far = F.col("best.other_n") >= rule.ratio * F.col("n")
    found = workspace.written(best.select(
        "word", "n_near", F.when(far, F.col("best.other")).alias("form"), F.when(far, F.col("best.other_n")).alias("form_n")), "spelling_forms")
    roots = _roots(found.where("form is not null"))
    return words.join(found, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
