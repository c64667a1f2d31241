"""BPE against the tokenizers library, the language model and toxicity scores against plain counterparts and held-out accuracy."""

import random

import numpy as np
import public_tokenizers
import pytest
import texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packetlens.llm import bpe, lm, tokens, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["", "  ", "\n\n a  b\t\tc  ", "don't 'tis I'LL we'll '' 's's x's1 'sa 'veb", "<|endoftext|>a<|endoftext|> <|endoftext|>", "a" * 5000,
       "aaa aaaa ababab", "é日本語 ١٢٣ ½   x\x85y \x1c\x1d z", "😀😀 ﻿", "x   '  s", "'", "\r\n\r\n  x", "1234567890.5,3-4__!!??",
       "ＡＢＣ ǅ ª º ² Ⅷ", "᠎​ a", "''s", "　 x", "a b"]


def test_encodes_like_the_library(vocabulary, library):
    rng = random.Random(1)
    letters = list(" \n\t'aes tmdlrv1é日.! 😀<|>")
    rows = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    found = bpe.Encoder(vocabulary).encode(rows)
    assert [x.tolist() for x in found] == [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_round_trip(rows):
    rows = [r.encode("utf-8", "ignore").decode() for r in rows]
    vocabulary = bpe.Vocabulary.load(PATH)
    ids = bpe.Encoder(vocabulary).encode(rows) if rows else []
    assert [b"".join(vocabulary.raw[i] for i in x).decode() for x in ids] == rows


def test_frames(spark, vocabulary, library):
    docs = texts.odd(spark)
    coded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert set(coded.columns) == set(docs.columns) | {"token_ids", "decoded"}
    rows = coded.collect()
    assert len(rows) == len(texts.odd_rows())
    for r in rows:
        assert r.decoded == (r.text or "") and r.row == "own"
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode(texts.empty(spark), vocabulary).count() == 0
    strange = spark.createDataFrame([(None,), ([-1, 10 ** 6, 50256],), ([252],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode(strange, vocabulary).collect()] == ["", "<|endoftext|>", library.decode([252], skip_special_tokens=False)]


def cell_counts(rows, rule, word_class):
    """Counts of (before, at, after) by plain loops."""
    out = {}
    for text in rows:
        codes, _ = lm._codes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), rule.bits)
        line = [0, *(int(word_class[c]) for c in codes), 0]
        for k in range(1, len(line) - 1):
            key = (line[k - 1], line[k], line[k + 1])
            out[key] = out.get(key, 0) + 1
    return out


def test_lm_counts_and_scores(spark):
    rule = lm.MaskedLm(bits=10, frequent=6, shared=3, hidden=8, steps=60)
    docs = texts.odd(spark)
    model = lm.fit(docs, rule)
    rows = [r[1] or "" for r in texts.odd_rows()]
    counted = lm._counted(docs.select("text"), rule, model.word_class).reshape([rule.classes] * 3)
    want = cell_counts(rows, rule, model.word_class)
    assert counted.sum() == sum(want.values()) and all(counted[k] == n for k, n in want.items())
    between = model.between.reshape([rule.classes] * 3)
    assert np.allclose(np.exp(between).sum(axis=1), 1)
    for c in np.unique(model.word_class):
        assert np.isclose(np.exp(model.inside[model.word_class == c]).sum(), 1)
    scored = lm.score(docs, model).collect()
    assert len(scored) == len(rows)
    for r in scored:
        assert (r.per_word is None) == (r.n_words == 0) and r.log_likelihood <= 0
    codes, _ = lm._codes(np.frombuffer(rows[0].encode(), np.uint8), np.array([0, len(rows[0])]), rule.bits)
    line = [0, *(int(model.word_class[c]) for c in codes), 0]
    total = sum(between[line[k], line[k + 1], line[k + 2]] + model.inside[c] for k, c in enumerate(codes))
    assert np.isclose(next(r.log_likelihood for r in scored if r.doc_id == 1), total)


def test_lm_learns_and_ignores_layout(spark):
    rng = random.Random(3)
    # what stands in the middle follows from both sides
    rows = [(k, " ".join(f"{a} {'x' if a == b else 'y'} {b}" for a, b in ((rng.choice("pq"), rng.choice("pq")) for _ in range(40)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = lm.MaskedLm(bits=8, frequent=6, shared=2, hidden=8, steps=200)
    one, two = lm.fit(docs.coalesce(1), rule), lm.fit(docs.repartition(7), rule)
    assert (one.between == two.between).all() and (one.inside == two.inside).all()
    good = lm.score(docs, one).agg({"per_word": "avg"}).first()[0]
    shuffled = [(k, " ".join(rng.sample(t.split(), len(t.split())))) for k, t in rows]
    bad = lm.score(spark.createDataFrame(shuffled, "doc_id long, text string"), one).agg({"per_word": "avg"}).first()[0]
    assert good > bad + 0.3
    empty = lm.fit(texts.empty(spark), rule)
    assert lm.score(texts.empty(spark), empty).count() == 0


def test_lm_counts_by_words(spark):
    """Each word by how often it stands between the same two words elsewhere, by plain loops."""
    rows = [(r[0], r[1]) for r in texts.odd_rows()] + [(100 + k, texts.prose(k, 80, 3)) for k in range(30)]
    # rare words that follow from both sides; a model of 64 classes cannot tell them from others of their class
    rows += [(200 + k, " ".join(f"left{j} mid{j if k < 10 else (j + k) % 300} right{j}" for j in range(300))) for k in range(12)]
    path_rows = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    rule = lm.MaskedLm(bits=12, steps=20, bucket_words=500)
    model = lm.fit(path_rows, rule)
    lines = []
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w = tokens.split_words(tokens.lower_ascii(data), np.array([0, len(data)]), tokens.is_letter(data))
        lines.append([0, *w.hashes().tolist(), 0])
    triple, context = {}, {}
    for line in lines:
        for b, w, a in zip(line, line[1:-1], line[2:]):
            triple[b, w, a] = triple.get((b, w, a), 0) + 1
            context[b, a] = context.get((b, a), 0) + 1
    between = model.between.reshape([rule.classes] * 3)
    want = {}
    for (doc, _), line in zip(rows, lines, strict=True):
        total = 0.0
        codes = [h >> (64 - rule.bits) for h in line[1:-1]]
        kinds = [0, *(int(model.word_class[c]) for c in codes), 0]
        for k, (b, w, a) in enumerate(zip(line, line[1:-1], line[2:])):
            network = np.exp(between[kinds[k], kinds[k + 1], kinds[k + 2]] + model.inside[codes[k]])
            total += np.log((triple[b, w, a] - 1 + rule.weight * network) / (context[b, a] - 1 + rule.weight))
        want.setdefault(doc, []).append((len(line) - 2, total))
    found = {}
    for r in lm.score_by_words(path_rows, model).collect():
        assert (r.per_word is None) == (r.n_words == 0)
        found.setdefault(r.doc_id, []).append((r.n_words, r.log_likelihood))
    assert set(found) == set(want)
    for doc, values in want.items():
        for (n, x), (m, y) in zip(sorted(values), sorted(found[doc]), strict=True):
            assert n == m and np.isclose(x, y, rtol=1e-6, atol=1e-6)
    assert found[200][0][1] > found[211][0][1] + 300
    assert lm.score_by_words(texts.empty(spark), lm.fit(texts.empty(spark), rule)).count() == 0


def toxic_rows(n=900):
    rng = random.Random(5)
    insults = ["clodpate", "numskull", "dunderhead"]
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.15
        w = texts.prose(k, 60).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", "s", "ish", ","]))
        rows.append((k, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((k, int(toxic)))
    return rows, labels, {k for k, t in rows if any(i in t for i in insults)}


def test_toxicity_held_out_accuracy(spark):
    rows, labels, truth = toxic_rows()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    found = toxicity.score(docs, model).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    hits = sum(r.predicted == (r.doc_id in truth) for r in held)
    assert hits / len(held) > 0.95 and all(0 <= r.score <= 1 for r in found)
    # labels of held-out rows change nothing
    flipped = [(k, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, t in labels]
    other = toxicity.fit(docs.repartition(5), spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert (other.weights == model.weights).all() and other.bias == model.bias


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(texts.odd(spark), labels)
    found = toxicity.score(texts.odd(spark), model).collect()
    assert len(found) == len(texts.odd_rows()) and all(0 <= r.score <= 1 for r in found)
    nothing = toxicity.fit(texts.empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(texts.empty(spark), nothing).count() == 0
    assert all(r.score == pytest.approx(1e-4) for r in toxicity.score(texts.odd(spark), nothing).collect())


def test_negative_risk_is_undone():
    """With a prior far too large the unlabelled risk would go below zero; the fit stays finite all the same."""
    rule = toxicity.PuLearning(bits=8, steps=200, excess=0.0)
    rng = np.random.default_rng(0)
    positive = [np.unique(np.r_[7, rng.integers(20, 200, 5)]) for _ in range(50)]
    unlabelled = [np.unique(rng.integers(20, 200, 5)) for _ in range(200)] + positive[:10]
    for prior in (0.05, 0.15, 0.9):
        model = toxicity.fit_codes(positive, unlabelled, prior, rule)
        assert np.isfinite(model.weights).all() and model.weights[7] > 0
    assert toxicity.fit_codes(positive, unlabelled, 0.05, rule).weights.argmax() == 7


def test_words_and_hashes_do_not_depend_on_chunks():
    import pyarrow as pa

    column = pa.array([r[1] for r in texts.odd_rows()])
    seen = {}
    for size in (1, 1000, 1 << 22):
        out = []
        for _, _, data, offsets in tokens.chunks(column, size):
            w = tokens.split_words(data, offsets)
            h = w.hashes()
            for k in range(len(offsets) - 1):
                out.append((w.text(w.first[k], w.first[k + 1]), h[w.first[k]:w.first[k + 1]].tolist()))
        seen[size] = out
    assert seen[1] == seen[1000] == seen[1 << 22]
    assert [t.decode().split(" ") if t else [] for t, _ in seen[1]] == [texts.words(r[1]) for r in texts.odd_rows()]
