"""The pipeline on the smallest tables, stage by stage, against plain counterparts; and odd tables through it."""

import public_tokenizers
import texts
from test_pairs import classes, shingles
from test_rules import base_spans, letters, plain_distance, plain_measures
from tokenizers import Tokenizer

import corpus_pipeline as P
from packetlens.llm import decontaminate
from packetlens.plans import workspace

SF = "/root/testdata/sf0.001"


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_by_plain_counterparts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [by_id(docs)]
    for name, stage in P.STAGES:
        docs = workspace.written(stage(spark, docs, SF), "stage")
        kept.append(by_id(docs))
        assert len(kept[-1]) == docs.count(), name
        if (name, stage) != P.STAGES[-1]:
            assert docs.columns == columns, name
    source, good, single, clean, private, coded = kept

    # too few labels for any cutoff: the base rules alone decide
    fine = {k for k, r in source.items() if (m := plain_measures(r.text))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert set(good) == fine
    sets = {k: [shingles(r.text, width=5)] for k, r in good.items()}
    assert set(single) == {k for k, c in classes(sets, 80).items() if c == k}
    items = [letters(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rule = decontaminate.Decontamination()
    spelled = {k: f" {' '.join(letters(r.text))} " for k, r in single.items()}
    exact = {k for k, t in spelled.items() if any(f" {' '.join(i)} " in t for i in items)}
    gone = set(single) - set(clean)
    assert exact <= gone and set(clean) <= set(single)
    for k in gone:
        assert any(plain_distance(i, letters(single[k].text)) <= rule.edits(len(i)) for i in items)
    assert set(private) == set(clean)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, r in private.items():
        assert base_spans(r.text) == "" and r.n_chars == len(r.text)
        if not base_spans(clean[k].text):
            assert r.text == clean[k].text
        assert coded[k].token_ids == library.encode(r.text, add_special_tokens=False).ids and coded[k].n_tokens == len(coded[k].token_ids)
    whole = by_id(P.run(spark, SF))
    assert {k: r.token_ids for k, r in whole.items()} == {k: r.token_ids for k, r in coded.items()}


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (texts.odd(spark), texts.empty(spark)):
        columns = docs.columns
        for name, stage in P.STAGES:
            docs = workspace.written(stage(spark, docs, SF), "stage")
            if (name, stage) != P.STAGES[-1]:
                assert docs.columns == columns, name
        assert docs.columns == ["doc_id", "n_tokens", "token_ids"]


def test_near_duplicate_stage_drops_copies_between_80_and_90_percent(spark):
    rows = []
    for n in range(4):
        base = texts.prose(n, 400, 5000).split()
        edited = [f"new{n}x{k}" if k % 50 == 25 else w for k, w in enumerate(base)]   # a word in fifty is replaced
        longer = base + texts.prose(100 + n, 72, 5000).split()                        # 18 percent are added
        apart = [f"far{n}x{k}" if k % 20 == 10 else w for k, w in enumerate(base)]    # a word in twenty: no near copy
        rows += [(10 * n + k, " ".join(w)) for k, w in enumerate((base, edited, longer, apart))]
    sets = {k: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for k, t in rows for w in [t.split()]}
    for n in range(0, 40, 10):
        like = [len(sets[n] & sets[n + k]) / len(sets[n] | sets[n + k]) for k in (1, 2, 3)]
        assert 0.8 <= like[0] < 0.9 and 0.8 <= like[1] < 0.9 and like[2] < 0.8
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF)
    assert {r.doc_id for r in kept.collect()} == {n + k for n in range(0, 40, 10) for k in (0, 3)}
