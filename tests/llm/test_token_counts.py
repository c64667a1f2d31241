"""Token counts against the tokenizers library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packetlens.llm import bpe, catalog, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "\n\n a  b\t\tc  ", "don't 'tis I'LL we'll '' 's's x's1", "<|endoftext|>a<|endoftext|> <|endoftext|>", "<|endof", "text|>",
       "a" * 5000, "é日本語 ١٢٣ ½   x\x85y \x1c\x1d z", "😀😀 ﻿", "\r\n\r\n  x", "1234567890.5,3-4__!!??", "'", "x  " * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sizes(library, rows):
    return [len(x.ids) for x in library.encode_batch(rows, add_special_tokens=False)]


def test_pre_tokens_of_small_parts(library):
    """Cut into parts of a few bytes, texts give the pre-tokens that the library finds in the whole."""
    rng = random.Random(3)
    rows = ODD + ["".join(rng.choice(" \n'aes mdlé日.!1  ") for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = [r for r in rows if "<|endoftext|>" not in r]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(r.encode()) for r in rows)])
    cuts = token_counts.piece_offsets(data, offsets, np.zeros((0, 2), np.int64), bpe.Kinds(), 10)
    ends = set()
    for start, r in zip(offsets[:-1].tolist(), rows, strict=True):
        for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(r):
            ends.add(start + len(r[:a].encode()))
    assert set(cuts[:-1].tolist()) == ends


def test_odd_rows(spark, library):
    docs = texts.odd(spark)
    more = [(100 + k, t, "en", "s", 0) for k, t in enumerate(ODD)]
    docs = docs.unionByName(spark.createDataFrame(more, texts.SCHEMA), allowMissingColumns=True)
    tokenizer = token_counts.Tokenizer.load(PATH)
    rows = token_counts.count_tokens(docs, tokenizer).collect()
    expected = [(r[0], r[1] or "") for r in [*texts.odd_rows(), *more]]
    n = sizes(library, [t for _, t in expected])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == sorted(
        (str(i), len(t.encode()), k) for (i, t), k in zip(expected, n, strict=True))
    assert token_counts.count_tokens(texts.empty(spark), tokenizer).count() == 0


def test_texts_of_several_parts(library):
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "don't", "日本", "x1", "end.\n", "<|endoftext|>"]) for _ in range(250_000))
    data = np.frombuffer((long * 2).encode(), np.uint8)
    half = len(long.encode())
    offsets = np.array([0, half, 2 * half])
    fixed, ends, piece, times, names = token_counts.frequencies(data, offsets, (b"<|endoftext|>",), bpe.Kinds())
    assert fixed.tolist() == [long.count("<|endoftext|>")] * 2
    size = np.array(sizes(library, [p.decode() for p in names.to_pylist()]))
    size[[p.as_py() == b"<|endoftext|>" for p in names]] = 0
    n = np.add.reduceat(size[piece] * times, [0, ends[0]]) + fixed
    assert n.tolist() == sizes(library, [long, long])


def test_query_counts_as_the_library(spark, library):
    rows = {r.doc_id: r for r in catalog.op12_token_counts(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n = sizes(library, [d.text or "" for d in docs])
    assert len(rows) == len(docs)
    for d, k in zip(docs, n, strict=True):
        assert tuple(rows[d.doc_id]) == (d.doc_id, len((d.text or "").encode()), k, k > 1024)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 300_000), st.integers(1, 2000), max_size=6), min_size=1, max_size=5))
def test_packed_entries(rows):
    piece = np.array([p for r in rows for p in sorted(r)], np.int64)
    times = np.array([r[p] for r in rows for p in sorted(r)], np.int64)
    ends = np.cumsum([len(r) for r in rows])
    gaps = token_counts.gaps_of(ends, piece)
    assert (gaps >= 0).all() and token_counts.pieces_of(ends, gaps).tolist() == piece.tolist()
    for values, kind in ((gaps, np.uint16), (times, np.uint8), (times * 0, np.uint8), (gaps, np.uint8)):
        assert token_counts.spread(token_counts.squeezed(values, kind)).tolist() == values.tolist()


def test_buckets_hold_every_name_once():
    names = pa.array([f"n{k}".encode() * (1 + k % 100) for k in range(500)], pa.large_binary())
    names = names.take(pa.array(np.argsort(token_counts.hashes(names))))
    sizes, letters = token_counts.unjoined(names)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7]), pa.array([token_counts.squeezed(sizes).tobytes()]), pa.array([letters.tobytes()])], ["chunk", "sizes", "names"])
    (out,) = token_counts._bucket_rows(23)(iter([batch]))
    found = [token_counts.joined(token_counts.spread(np.frombuffer(s, np.uint8)), n).to_pylist()
             for s, n in zip(out.column("sizes").to_pylist(), out.column("names").to_pylist(), strict=True)]
    assert out.column("bucket").to_pylist() == list(range(23)) and [n for part in found for n in part] == names.to_pylist()
