"""Near words against plain edit distances, whole results against plain counting, and the k-d search against all pairs."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import texts
from hypothesis import given, settings
from hypothesis import strategies as st

from packetlens.llm import spelling

LOW = {i: i + 32 for i in range(65, 91)}


def counts(rows, rule):
    out = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if rule.drop_every and h % rule.drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= rule.least_chars and n >= rule.least_times}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(words, rule):
    """All columns of every word by comparing all pairs."""
    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if one_edit(w, x)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= rule.ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, n, len(near[w]), form[w], None if form[w] is None else words[form[w]], root(w)) for w, n in words.items()}


def family(rng, letters, size):
    """Words around one, each a few edits away."""
    base = "".join(rng.choice(letters) for _ in range(size))
    out = [base]
    for _ in range(25):
        w = list(rng.choice(out))
        at = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[at] = rng.choice(letters)
        elif kind == 1:
            w.insert(at, rng.choice(letters))
        elif kind == 2 and len(w) > 1:
            del w[at]
        else:
            rng.shuffle(w)
        out.append("".join(w))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 6), st.sampled_from(["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzéÀ÷ÿ"]), st.sampled_from([1, 2, 5]))
def test_cells_find_all_pairs(seed, letters, cells):
    """Words dealt to cells of cut trees: every pair one edit apart is found once."""
    rng = random.Random(seed)
    words = sorted({w for _ in range(4) for w in family(rng, letters, rng.randrange(1, 12)) if w})
    rule = spelling.Spelling(leaf=3)
    trees = {}
    for n in {len(w) for w in words}:
        mine = [w for w in words if len(w) == n]
        if cells > 1 and len(mine) > 1:
            trees[n] = spelling.KdTree.of(spelling.points_of(*spelling.letter_codes(pa.array(mine[::2]))), max(1, len(mine) // cells))
    dealt = spelling._dealt(trees)
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.ones(len(words), np.int64))], ["word", "n"])
    groups = collections.defaultdict(list)
    for out in dealt(iter([batch])):
        for r in out.to_pylist():
            groups[r["length"], r["cell"]].append((r["word"], r["role"]))
    found = []
    for rows in groups.values():
        pairs = spelling.near_in_cell(pa.array([w for w, _ in rows]), np.array([r for _, r in rows]), rule)
        found += [tuple(sorted((rows[i][0], rows[j][0]))) for i, j in pairs.tolist()]
    assert sorted(found) == sorted((a, b) for k, a in enumerate(words) for b in words[k + 1:] if one_edit(a, b))


def test_points_of_very_long_words_prune_nothing():
    base = "a" * 400 + "b" * 400
    words = [base, base[:-1] + "c", base + "b", "b" + base[1:], base.replace("b", "d")]
    rule = spelling.Spelling(leaf=1)
    same = [w for w in words if len(w) == 800]
    pairs = spelling.near_in_cell(pa.array(same), np.zeros(len(same), np.int64), rule)
    assert {frozenset((same[i], same[j])) for i, j in pairs.tolist()} == {
        frozenset((a, b)) for a in same for b in same if a < b and one_edit(a, b)}
    both = [words[2], words[0]]
    assert spelling.near_in_cell(pa.array(both), np.array([spelling.HOME, spelling.SHORTER]), rule).tolist() == [[1, 0]]


def rows_of(frame):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_variants_of_odd_rows(spark):
    rng = random.Random(4)
    said = [" ".join(w for f in range(30) for w in family(random.Random(f), "abcdefé", 9)[:rng.randrange(26)]) for _ in range(40)]
    said += ["Wonderful " * 200 + "wonderfull wonderfull wonderfulll wonderfulll " * 3, "ÉCOLIERS écoliers Écoliers ×÷ÀÿØ×÷ÀÿØ " * 4]
    more = [(100 + k, t, "en", "s", 0) for k, t in enumerate(said)]
    docs = texts.odd(spark).unionByName(spark.createDataFrame(more, texts.SCHEMA), allowMissingColumns=True)
    keyed = [(r[0], r[1]) for r in [*texts.odd_rows(), *more]]
    for rule in (spelling.Spelling(), spelling.Spelling(drop_every=3, least_chars=5),
                 spelling.Spelling(drop_every=31, least_chars=4, least_times=1, ratio=2, cell_words=40, least_sample=4, leaf=4)):
        words = counts(keyed, rule)
        found = spelling.variants(docs, rule).collect()
        assert len(found) == len(words)
        assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == plain(words, rule)
        if rule.cell_words == 40:
            assert spelling.cell_trees(spelling.word_counts(docs, rule), rule)
    assert spelling.variants(texts.empty(spark)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    rows = [(1, " ".join(f"{w} " * n for w, n in zip(chain, (2, 20, 200, 2000), strict=True)))]
    found = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == {("abcdefgh", 2, 1, chain[1], 20, chain[3]), (chain[1], 20, 2, chain[2], 200, chain[3]),
                     (chain[2], 200, 2, chain[3], 2000, chain[3]), (chain[3], 2000, 1, None, None, chain[3])}
