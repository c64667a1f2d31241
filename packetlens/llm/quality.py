"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Fixed base rules reject texts that are too short or repeat themselves. Further rules compare a measure of
the text with a cutoff that labelled holdouts select: for each stratum (language) and rule, cutoffs are
tried from lenient to strict, and a cutoff stands while the exact binomial test shows that fewer than
``risk`` of the good texts would be rejected. The sequence stops at the first failure, so its members
need no correction among each other; strata and rules are corrected by Bonferroni. Strata with too few
labels have no cutoff and reject nothing beyond the base rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import workspace

# fixed values: what separates words, and what counts as a symbol
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOL = r"[#*$%&|<>]"


def _grid(high: float, low: float, steps: int = 24) -> tuple[float, ...]:
    return tuple(high * (low / high) ** (k / (steps - 1)) for k in range(steps))


@dataclass(frozen=True)
class QualityRules:
    """Settings. ``risk``: largest share of good texts that all rules of a stratum together may reject;
    ``error``: probability that any of the guarantees fails. ``cutoffs``: rule -> values from lenient to
    strict; a text whose measure is above the selected value is rejected."""

    least_words: int = 50
    most_repeated: int = 50
    risk: float = 0.02
    error: float = 0.05
    broadcast_strata: int = 10_000
    cutoffs: dict[str, tuple[float, ...]] = field(default_factory=lambda: {
        "symbols_per_char": _grid(0.5, 0.002), "dup_lines_per_line": _grid(0.9, 0.02),
        "repeats_per_word": _grid(0.5, 0.01), "chars_per_word": _grid(60.0, 6.0)})


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _windows(docs: DataFrame, text: str) -> DataFrame:
    """Adds the words of the text and the hashes of their windows of three."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    out = docs.withColumn("__words", words)
    hashes = F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    return out.withColumn("__hashes", F.slice(hashes, 1, F.greatest(F.size("__words") - 2, F.lit(0))))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__measures`` of the counts in ``MEASURES``; null texts are empty.

    n_repeat_words counts words in three-word windows that the text has twice or more; windows are told
    apart by 64-bit hashes. Only texts with such a window sort their windows.
    """
    kept = docs.columns
    out = _windows(docs, text)
    full = F.expr(r"filter(split(coalesce(%s, ''), '\n', -1), l -> l rlike r'[^\x20\x09-\x0D]')" % f"`{text}`")
    out = out.withColumn("__lines", full).withColumn("__again", F.size(F.array_distinct("__hashes")) < F.size("__hashes"))
    pairs = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("__sorted", F.when(F.col("__again"), F.array_sort(pairs)))
    twice = F.expr("""filter(__sorted, (x, j) ->
        coalesce(x.h = get(__sorted, j - 1).h, false) or coalesce(x.h = get(__sorted, j + 1).h, false))""")
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    found = F.struct(
        F.size("__words").cast("long").alias("n_words"), F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("__lines").cast("long").alias("n_lines"))
    # as the one element of an array: else filters on the counts are pushed down with all that computes them
    return out.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(found)).alias("__measures"))


def base_failed(m: Column, rule: QualityRules) -> Column:
    return (m["n_words"] < rule.least_words) | (100 * m["n_repeat_words"] > rule.most_repeated * m["n_words"])


def _values(m: Column) -> dict[str, Column]:
    def ratio(a: str, b: str) -> Column:
        return F.coalesce(m[a].cast("double") / F.nullif(m[b].cast("double"), F.lit(0.0)), F.lit(0.0))

    return {
        "symbols_per_char": ratio("n_symbols", "word_chars"), "dup_lines_per_line": ratio("n_dup_lines", "n_lines"),
        "repeats_per_word": ratio("n_repeat_words", "n_words"), "chars_per_word": ratio("word_chars", "n_words")}


def _log_gamma(x: Column) -> Column:
    """Stirling's series, ten steps up from ``x``."""
    product = F.lit(0.0)
    for k in range(10):
        product = product + F.log(x + k)
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - product


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most ``k`` of ``n``) for k below n p, else 1: the terms from k down, until they no longer count."""
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.least(k, F.ceil(60 + 10 * F.sqrt(n * p)).cast("double")).cast("long")
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), terms), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct(
            (acc["sum"] + acc["term"]).alias("sum"),
            (acc["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term")), lambda acc: acc["sum"])
    return F.when(k < n * p, F.least(F.lit(1.0), first * total)).otherwise(F.lit(1.0))


def cutoffs(docs: DataFrame, labels: DataFrame, rule: QualityRules = QualityRules()) -> DataFrame:
    """(stratum, rule -> cutoff map) of the cutoffs that stand, one row per stratum with any labelled good text.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality. A text is good if all its labels are 1.
    Texts that fail the base rules are not counted; null languages are a stratum of their own.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    measured = measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("stratum")))
    rows = measured.where(~base_failed(F.col("__measures"), rule)).select("doc_id", "stratum", "__measures").join(good, "doc_id")
    values = _values(F.col("__measures"))
    counts = [
        F.sum((values[name] > cut).cast("long")).alias(f"{name}_{k}")
        for name, cuts in rule.cutoffs.items() for k, cut in enumerate(cuts)]
    held = rows.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    # Bonferroni over the rules and over all strata of the table
    held = workspace.written(held, "quality_holdouts")
    n_strata = max(1, held.count())
    level = rule.error / (n_strata * len(rule.cutoffs))
    risk = rule.risk / len(rule.cutoffs)
    tried = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(k).alias("k"), F.lit(cut).alias("cut"), F.col(f"{name}_{k}").alias("rejected"))
        for name, cuts in rule.cutoffs.items() for k, cut in enumerate(cuts)])
    tests = held.select("stratum", "n", F.explode(tried).alias("t")).select("stratum", "n", "t.*")
    tests = tests.withColumn("stands", binomial_tail(F.col("rejected"), F.col("n"), risk) <= level)
    # the strictest of the cutoffs before the first that fails
    lists = tests.groupBy("stratum", "rule").agg(F.array_sort(F.collect_list(F.struct("k", "cut", "stands"))).alias("tests"))
    failed = F.expr("coalesce(nullif(array_position(transform(tests, t -> t.stands), false), 0) - 1, size(tests))")
    picked = lists.withColumn("passed", failed.cast("int")).where("passed > 0").select(
        "stratum", "rule", F.expr("element_at(tests, passed).cut").alias("cut"))
    return picked.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))


def judge(docs: DataFrame, found: DataFrame, rule: QualityRules = QualityRules()) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with ``measures``, ``base_failed`` and ``kept``.

    ``docs`` may have any further columns, whatever their names. Null and empty texts have no words and
    fail the base rules. Every row is judged by itself, so repeated rows get the same verdict.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"), F.col("lang").alias("stratum"))
    rows = measures(rows)
    few = found.count() <= rule.broadcast_strata
    side = found.select(F.col("stratum").alias("__stratum"), "cuts")
    joined = rows.join(F.broadcast(side) if few else side, rows["stratum"].eqNullSafe(F.col("__stratum")), "left")
    values = _values(F.col("__measures"))
    over = F.lit(False)
    for name in rule.cutoffs:
        over = over | F.coalesce(values[name] > F.try_element_at("cuts", F.lit(name)), F.lit(False))
    bad = base_failed(F.col("__measures"), rule)
    return joined.select("row", F.col("__measures").alias("measures"), bad.alias("base_failed"), (~bad & ~over).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, rule: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return judge(docs, workspace.written(cutoffs(docs, labels, rule), "quality_cutoffs"), rule).where("kept").select("row.*")
