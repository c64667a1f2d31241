"""Toxicity scores from positive and unlabelled texts.

Only confirmed toxic texts are used as labelled; everything else is unlabelled. The risk of a
classifier is then pi * R(positive as 1) + R(unlabelled as 0) - pi * R(positive as 0), where pi is the class prior.
The last two terms estimate a risk and cannot be negative; when they are, the step undoes them
instead (non-negative correction), which keeps a flexible model from overfitting the positives.

The model is a logistic regression on which hashed words and word beginnings a text has, trained in numpy on the
driver from two bounded samples; scoring runs in Arrow tasks over all texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens


PREFIXES = (4, 5, 6)  # bytes; insults are inflected


@dataclass(frozen=True)
class PuLearning:
    """Settings; the samples hold the texts with the smallest hashes of their doc_id.

    At most ``positives`` toxic and ``unlabelled`` texts of any kind are fitted, with the ``features`` words that are
    most over-represented in the toxic ones, by at least ``excess`` standard deviations.
    """

    positives: int = 3_000
    unlabelled: int = 8_000
    features: int = 4_096
    excess: float = 5.0
    bits: int = 20
    steps: int = 300
    rate: float = 0.1
    shrink: float = 0.0005
    held_out: int = 1
    folds: int = 3
    threshold: float = 0.7


def held_out(doc_id: Column, rule: PuLearning = PuLearning()) -> Column:
    """Rows kept back: CRC-32 of the id as text falls in one of the folds. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % rule.folds == rule.held_out


def word_codes(words: tokens.Words, bits: int) -> np.ndarray:
    """A code for each word and for its beginnings of the lengths in ``PREFIXES``; one row per kind."""
    kinds = [words.hashes()]
    for size in PREFIXES:
        kinds.append(tokens.mix(tokens.span_hashes(words.data, words.starts, np.minimum(words.ends, words.starts + size)) + np.uint64(size)))
    return (np.stack(kinds) >> np.uint64(64 - bits)).astype(np.int64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tokens.Words:
    return tokens.split_words(tokens.lower_ascii(data), offsets, tokens.is_letter(data))


def distinct_codes(words: tokens.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct words and beginnings of each row."""
    rows = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    both = np.unique((rows << bits) | word_codes(words, bits))
    return both >> bits, both & ((1 << bits) - 1)


def _code_rows(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tokens.chunks(batch.column("text")):
                rows, codes = distinct_codes(words_of(data, offsets), bits)
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes, pa.int32()))], ["toxic", "codes"])
    return run


@dataclass
class Model:
    weights: np.ndarray   # by word code
    bias: float
    bits: int


def _sparse(rows: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of all entries, leaving out words that are no features."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = place[np.concatenate(rows)] if rows else row
    return row[feature >= 0], feature[feature >= 0]


def fit_codes(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rule: PuLearning) -> Model:
    """Non-negative PU logistic regression on word sets; without positives every score is the prior."""
    size = 1 << rule.bits
    prior = min(max(prior, 1e-4), 0.999)
    weights = np.zeros(size)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(weights, bias, rule.bits)
    in_positive = np.bincount(np.concatenate(positive), minlength=size) / len(positive)
    in_other = np.bincount(np.concatenate(unlabelled), minlength=size) / len(unlabelled)
    spread = np.sqrt((in_other + 1 / len(unlabelled)) / len(positive))
    excess = (in_positive - in_other) / spread
    chosen = np.argsort(-excess, kind="stable")[:rule.features]
    chosen = chosen[excess[chosen] > rule.excess]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    p_row, p_feature = _sparse(positive, place)
    u_row, u_feature = _sparse(unlabelled, place)
    w, n = np.zeros(len(chosen) + 1), len(chosen)  # the last is the bias
    w[n] = bias
    first, second = np.zeros(n + 1), np.zeros(n + 1)

    def scores(row: np.ndarray, feature: np.ndarray, count: int) -> np.ndarray:
        return np.bincount(row, w[feature], count) + w[n]

    def gradient(row: np.ndarray, feature: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(feature, slope[row], n), slope.sum()) / len(slope)

    for step in range(1, rule.steps + 1):
        zp, zu = scores(p_row, p_feature, len(positive)), scores(u_row, u_feature, len(unlabelled))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = gradient(u_row, u_feature, su) - prior * gradient(p_row, p_feature, sp)
        g = prior * gradient(p_row, p_feature, sp - 1) + negative if rest >= 0 else -negative
        g[:n] += rule.shrink * w[:n]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rule.rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    weights[chosen] = w[:n]
    return Model(weights, float(w[n]), rule.bits)


def fit(docs: DataFrame, labels: DataFrame, rule: PuLearning = PuLearning()) -> Model:
    """Train on rows that are not held out. ``docs``: doc_id, text; ``labels``: doc_id, toxic.

    The prior is the share of toxic rows among the labelled ones. A doc_id with several labels
    is toxic if any says so; null labels and labels of unknown rows count for nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id"), rule))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), rule)).select(
        "doc_id", "text", F.xxhash64("doc_id").alias("draw"))
    # which rows are drawn is settled before texts are moved
    sure = rows.drop("text").join(known.where("toxic = 1"), "doc_id").orderBy("draw", "doc_id").limit(rule.positives)
    # the unlabelled sample is drawn from all texts, toxic ones among them, as the risk assumes
    other = rows.drop("text").orderBy("draw", "doc_id").limit(rule.unlabelled)
    drawn = sure.select("doc_id", F.lit(1).alias("toxic")).unionByName(other.select("doc_id", F.lit(0).alias("toxic")))
    # at most positives + unlabelled ids
    picked = rows.select("doc_id", "text").join(F.broadcast(drawn.distinct()), "doc_id").select("toxic", "text")
    found = picked.mapInArrow(_code_rows(rule.bits), "toxic int, codes array<int>").toArrow()
    toxic = found.column("toxic").to_numpy()
    codes = found.column("codes").combine_chunks()
    values, bounds = codes.flatten().to_numpy(), np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy())])
    lists = [values[bounds[i]:bounds[i + 1]] for i in range(len(toxic))]
    # copies count once, or words of a text with many copies would pass for toxic; sorted, as tasks end in any order
    parts = [sorted({lists[i].tobytes() for i in np.flatnonzero(toxic == kind)}) for kind in (1, 0)]
    return fit_codes(*([np.frombuffer(x, np.int32) for x in part] for part in parts), prior or 0.0, rule)


def _score_rows(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.astype(np.float64)
        used = weights != 0
        for batch in batches:
            for a, b, data, offsets in tokens.chunks(batch.column("text")):
                words = words_of(data, offsets)
                codes = word_codes(words, model.bits)
                hit = np.nonzero(used[codes])  # words without weight change nothing
                row = np.searchsorted(words.first, hit[1], "right") - 1
                both = np.unique((row << model.bits) | codes[hit])
                z = np.bincount(both >> model.bits, weights[both & ((1 << model.bits) - 1)], b - a) + model.bias
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model, rule: PuLearning = PuLearning()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; others are ignored).

    The score depends on the text alone; null and empty texts get the score of no words. Repeated
    rows and null ids are scored like any other; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_score_rows(model), "doc_id long, score double")
    return found.select(
        "doc_id", held_out(F.col("doc_id"), rule).alias("held_out"), "score",
        (F.col("score") >= rule.threshold).cast("int").alias("predicted"))
