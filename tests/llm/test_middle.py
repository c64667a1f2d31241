"""Boundary sets against plain lists, rearranged texts against slices, and exact restoring."""

import hashlib

import numpy as np
import pytest
import texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetlens.llm import middle


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(1, 9000), st.sampled_from([1, 2, 3, 50])), min_size=1, max_size=6))
def test_select_gives_the_kth_value(blocks):
    values = np.unique(np.concatenate([a + np.arange(n) * step for a, n, step in blocks]))
    found = middle.BoundarySet.of(values)
    assert len(found) == len(values)
    for k in {0, len(values) - 1, len(values) // 2, len(values) // 3, *range(0, len(values), max(1, len(values) // 50))}:
        assert found.select(k) == values[k]
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            found.select(k)


def test_every_kind_of_container():
    assert isinstance(middle.container(np.arange(100, 60_000)), middle.RunContainer)
    assert isinstance(middle.container(np.arange(0, 8000, 2)), middle.ArrayContainer)
    scattered = np.arange(0, 65_536, 3)
    held = middle.container(scattered)
    assert isinstance(held, middle.BitmapContainer)
    assert [held.select(k) for k in range(0, len(scattered), 97)] == scattered[::97].tolist()


def plain(key, text, rule):
    """Form and output of one text by slices of code points."""
    text = text or ""
    h = hashlib.sha256(f"{rule.salt}{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or any(m in text for m in rule.marks) or h[2] % 100 >= rule.percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < rule.suffix_first:
        return n, "spm", a, b - a, rule.suffix + s + rule.prefix + p + rule.middle + m
    return n, "psm", a, b - a, rule.prefix + p + rule.suffix + s + rule.middle + m


@pytest.mark.parametrize("rule", [
    middle.FillInMiddle(), middle.FillInMiddle(percent=100, suffix_first=50, salt="x"), middle.FillInMiddle(percent=0),
    middle.FillInMiddle(percent=100, prefix="\u0001pre", suffix="\u0002suf", middle="\u0003mid")])
def test_frames(spark, rule):
    more = [(100 + k, "日本é😀 a" * (1 + 7000 * (k % 3)) + "<" * (k % 4), "ja", "s", 0) for k in range(12)]
    more += [(200, "a <P> b", "en", "s", 0), (201, "<S>", "en", "s", 0), (202, "<<M>", "en", "s", 0), (203, "<P", "en", "s", 0)]
    docs = texts.odd(spark).withColumn("form", F.lit("own")).withColumn("n", F.lit("own"))
    docs = docs.unionByName(spark.createDataFrame(more, texts.SCHEMA), allowMissingColumns=True)
    found = middle.fill_in_middle(docs, rule)
    assert set(found.columns) == set(docs.columns) | {f.name for f in middle.ADDED}
    rows = found.withColumn("again", middle.restored(F.col("output"), F.col("form"), rule)).collect()
    assert len(rows) == len(texts.odd_rows()) + len(more)
    for r in rows:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain(r.doc_id, r.text, rule)
        assert r.again == (r.text or "")
    assert {r.form for r in rows} == {"plain"} if rule.percent == 0 else {"psm", "spm"} <= {r.form for r in rows}
    assert middle.fill_in_middle(texts.empty(spark), rule).count() == 0


def test_word_cuts_fall_before_words(spark):
    rule = middle.FillInMiddle(unit="word", percent=100)
    rows = middle.fill_in_middle(texts.odd(spark), rule).withColumn("again", middle.restored(F.col("output"), F.col("form"), rule)).collect()
    for r in rows:
        assert r.again == (r.text or "")
        if r.form == "psm":
            head, rest = r.output[len("<P>"):].split("<S>")
            tail, between = rest.split("<M>")
            for left, right in ((head, between), (between, tail)):
                assert not left or not right or (left[-1] in " \n\t" and right[0] not in " \n\t")


def test_marks_that_could_overlap_are_refused():
    for marks in (("aa", "b", "c"), ("<P>", "<P>", "<M>"), ("", "b", "c"), ("xa", "a", "c")):
        with pytest.raises(ValueError):
            middle.FillInMiddle(prefix=marks[0], suffix=marks[1], middle=marks[2])
