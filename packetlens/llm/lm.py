"""Masked pseudo-likelihood: how well each word of a text follows from the words on both sides.

For the network, words are hashed to a fixed vocabulary; the most frequent entries are classes of their own, the
others share some. A small bidirectional network reads the class of the word before and after a masked
place and gives the distribution of the class there; inside a class, words have their corpus frequency.

The conditional of a word is how often it stands between the same two words elsewhere in the corpus, smoothed by
a small network (``score_by_words``). These counts are keyed by the words themselves and grow with the corpus: each chunk
of texts sends each of its words once to a bucket by context, as 8 bytes (40 bits of the context beside its bucket, 24 of the
word), with the network's probability and the place of its text in the chunk. The bucket adds up the terms of each text, and
only these sums travel on; texts are read once and never shuffled, and no order of rows matters.

All the network ever sees of the corpus is how often each class stands between each two others. These
counts are taken over the whole corpus in Spark, so the network is trained in numpy on all of it, by full
gradients, and does not depend on partitioning. Their number is fixed by the settings, not by the data.
Scoring sums the conditional log-probabilities of all words of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

_WORD = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class MaskedLm:
    """Settings: ``bits`` of the word hash are kept; class 0 is a text's border.

    The network counts as much as ``weight`` occurrences of a context. A bucket has about ``bucket_words`` words.
    """

    bits: int = 18
    frequent: int = 48
    shared: int = 15
    hidden: int = 24
    steps: int = 150
    rate: float = 0.05
    seed: int = 7
    weight: float = 4.0
    bucket_words: int = 1 << 21

    @property
    def classes(self) -> int:
        return 1 + self.frequent + self.shared


@dataclass
class LmModel:
    word_class: np.ndarray   # class of each vocabulary entry
    inside: np.ndarray       # log-probability of each entry within its class
    between: np.ndarray      # log-probability of a class, by the classes before, at and after it
    rule: MaskedLm
    total: int = 0           # words of the corpus


def _codes(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    words = tokens.split_words(tokens.lower_ascii(data), offsets, tokens.is_letter(data))
    return (words.hashes() >> np.uint64(64 - bits)).astype(np.int64), words.first


def _neighbours(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values before and after each word; 0 beyond a text's border."""
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    full = first[:-1] < first[1:]
    before[first[:-1][full]] = 0
    after[first[1:][full] - 1] = 0
    return before, after


def _cells(classes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """One number for each word: the classes before, at and after it."""
    before, after = _neighbours(classes, first)
    return (before * n + classes) * n + after


def _tally(rule: MaskedLm, word_class: np.ndarray | None) -> Callable:
    """Counts of vocabulary entries, or of cells if the classes are known; one row per value and batch."""
    size = 1 << rule.bits if word_class is None else rule.classes ** 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(size, np.int64)
            for _, _, data, offsets in tokens.chunks(batch.column("text")):
                codes, first = _codes(data, offsets, rule.bits)
                if word_class is not None:
                    codes = _cells(word_class[codes], first, rule.classes)
                total += np.bincount(codes, minlength=size)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["value", "n"])
    return run


def _counted(docs: DataFrame, rule: MaskedLm, word_class: np.ndarray | None) -> np.ndarray:
    """Corpus counts; at most 2^bits or classes^3 rows come to the driver."""
    size = 1 << rule.bits if word_class is None else rule.classes ** 3
    found = docs.mapInArrow(_tally(rule, word_class), "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("value").to_numpy()] = found.column("n").to_numpy()
    return out


def train_network(counts: np.ndarray, rule: MaskedLm) -> np.ndarray:
    """Log-probabilities by (before, at, after), from a network fitted to the counts of the same shape."""
    n, h = rule.classes, rule.hidden
    rng = np.random.default_rng(rule.seed)
    left, right = (rng.normal(0, 0.3, (n, h)) for _ in range(2))
    out = rng.normal(0, 0.1, (h, n))
    target = counts.transpose(0, 2, 1).reshape(n * n, n).astype(np.float64)
    mass = target.sum(axis=1, keepdims=True)
    total = max(1.0, mass.sum())
    start = np.log((target.sum(axis=0) + 1) / (total + n))
    values = [left, right, np.zeros(h), out, start]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]

    def forward() -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh((values[0][:, None] + values[1][None] + values[2]).reshape(n * n, h))
        logits = hidden @ values[3] + values[4]
        logits -= logits.max(axis=1, keepdims=True)
        return hidden, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    for step in range(1, rule.steps + 1):
        hidden, logp = forward()
        slope = (np.exp(logp) * mass - target) / total
        back = (slope @ values[3].T * (1 - hidden ** 2)).reshape(n, n, h)
        grads = [back.sum(axis=1), back.sum(axis=0), back.sum(axis=(0, 1)), hidden.T @ slope, slope.sum(axis=0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            values[k] = values[k] - rule.rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return forward()[1].reshape(n, n, n).transpose(0, 2, 1)


def fit(docs: DataFrame, rule: MaskedLm = MaskedLm()) -> LmModel:
    """Train on all texts of ``docs`` (column text; null texts are empty). An empty table gives a uniform model."""
    docs = docs.select(F.col("text").cast("string").alias("text"))
    words = _counted(docs, rule, None)
    top = np.argsort(-words, kind="stable")[:rule.frequent]
    word_class = 1 + rule.frequent + np.arange(len(words)) % rule.shared
    word_class[top] = 1 + np.arange(len(top))
    cells = _counted(docs, rule, word_class)
    smooth = words + 0.5
    inside = np.log(smooth / np.bincount(word_class, smooth)[word_class])
    return LmModel(word_class, inside, train_network(cells.reshape([rule.classes] * 3), rule).reshape(-1), rule, int(words.sum()))


def _score_rows(model: LmModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tokens.chunks(batch.column("text")):
                codes, first = _codes(data, offsets, model.rule.bits)
                terms = model.between[_cells(model.word_class[codes], first, model.rule.classes)] + model.inside[codes]
                sums = [float(terms[s:e].sum()) for s, e in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(sums, pa.float64())],
                    ["doc_id", "n_words", "log_likelihood"])
    return run


def score(docs: DataFrame, model: LmModel) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word) for each row of ``docs`` (doc_id, text; others are ignored).

    ``log_likelihood`` sums log p(word | word before, word after) over the whole text; ``per_word`` is its
    mean, null for texts without words (null and empty ones), whose sum is 0. Repeated rows and null ids
    are scored like any other; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_score_rows(model), "doc_id long, n_words long, log_likelihood double")
    return found.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def _word_rows(model: LmModel, buckets: int) -> Callable:
    """For each chunk of texts one row with its ids and sizes, and one for each bucket it has words for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # only has to differ from the other chunks'
        for batch in batches:
            for a, b, data, offsets in tokens.chunks(batch.column("text")):
                words = tokens.split_words(tokens.lower_ascii(data), offsets, tokens.is_letter(data))
                hashes = words.hashes()
                before, after = _neighbours(hashes, words.first)
                context = tokens.mix(tokens.mix(before + np.uint64(1)) + after)
                codes = (hashes >> np.uint64(64 - model.rule.bits)).astype(np.int64)
                network = np.exp(model.between[_cells(model.word_class[codes], words.first, model.rule.classes)] + model.inside[codes])
                bucket = (((context & _WORD) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys = ((context & ~_WORD) | (hashes >> np.uint64(40)))[order]
                network = network[order].astype(np.float32)
                row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(words.first))[order]
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                spans = list(zip(edges[full].tolist(), edges[full + 1].tolist(), strict=True))
                none = [None] * len(full)
                columns = [
                    [-1, *full.tolist()], [number] * (len(full) + 1), [batch.column("doc_id").slice(a, b - a).to_pylist(), *none],
                    [np.diff(words.first).tolist(), *none]]
                types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                packed = [pa.array([None, *[x[s:e].tobytes() for s, e in spans]], pa.binary()) for x in (keys, network, row)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], *packed], _SENT)
                number += 1
    return run


_SENT = ["bucket", "chunk", "ids", "sizes", "keys", "network", "row"]
_SUMS = ["chunk", "bucket", "ids", "sizes", "row", "sum"]


def elsewhere(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key's word, and any word, stands in its context, the place itself left out."""
    names, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    context = np.cumsum(np.diff(names >> np.uint64(24), prepend=names[:1] >> np.uint64(24)) != 0)
    return n[which] - 1, np.bincount(context, n)[context][which] - 1


def _sum_rows(weight: float) -> Callable:
    """From rows sorted by bucket: for each chunk the sums of the terms of its texts; rows with ids pass."""

    def solve(bucket: int, rows: list) -> pa.RecordBatch:
        keys, network, row = ([np.frombuffer(r[k], t) for r in rows] for k, t in ((1, np.uint64), (2, np.float32), (3, np.int32)))
        n, total = elsewhere(np.concatenate(keys))
        terms = np.log((n + weight * np.concatenate(network).astype(np.float64)) / (total + weight))
        out, at = [], 0
        for own in row:  # texts come in order within a chunk
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            out.append((own[heads].tobytes(), np.add.reduceat(terms[at:at + len(own)], heads).tobytes()))
            at += len(own)
        none = [None] * len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(none, pa.list_(pa.int64())),
             pa.array(none, pa.list_(pa.int64())), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], _SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            whole = batch.filter(pc.equal(batch.column("bucket"), -1))
            if len(whole):
                none = pa.nulls(len(whole), pa.binary())
                yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in ("chunk", "bucket", "ids", "sizes")), none, none], _SUMS)
            batch = batch.filter(pc.not_equal(batch.column("bucket"), -1))
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "keys", "network", "row")), strict=True):
                if b != bucket:
                    if rows:
                        yield solve(bucket, rows)
                    bucket, rows = b, []
                rows.append(row)
        if rows:
            yield solve(bucket, rows)
    return run


def _scored_chunk(table: pa.Table) -> pa.Table:
    """The texts of a chunk with their sums, added up in the order of the buckets."""
    table = table.sort_by("bucket").combine_chunks()
    ids, sizes = table.column("ids")[0].as_py(), table.column("sizes")[0].as_py()
    total = np.zeros(len(ids))
    for row, part in zip(table.column("row").to_pylist()[1:], table.column("sum").to_pylist()[1:], strict=True):
        total[np.frombuffer(row, np.int32)] += np.frombuffer(part, np.float64)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(sizes, pa.int64()), "log_likelihood": pa.array(total)})


def score_by_words(docs: DataFrame, model: LmModel) -> DataFrame:
    """Like ``score``, with each word's conditional from the counts of ``docs``, smoothed by the network of ``model``.

    p = (n + weight * p of the network) / (N + weight): between the same two words, the word stands n times and any
    word N times at other places of ``docs``. ``docs`` is read once, in any order.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 24, max(width, -(-model.total // model.rule.bucket_words)))
    parts = max(width, buckets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.mapInArrow(
        _word_rows(model, buckets), "bucket int, chunk long, ids array<long>, sizes array<long>, keys binary, network binary, row binary")
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("chunk"), F.lit(parts))).otherwise(F.pmod("bucket", F.lit(parts)))
    sent = sent.repartitionById(parts, place.cast("int")).sortWithinPartitions("bucket", "chunk")
    sums = sent.mapInArrow(_sum_rows(model.rule.weight), "chunk long, bucket int, ids array<long>, sizes array<long>, row binary, sum binary")
    found = sums.groupBy("chunk").applyInArrow(_scored_chunk, "doc_id long, n_words long, log_likelihood double")
    return found.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
