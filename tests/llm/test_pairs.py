"""Near-duplicate links, repeated passages and connected components against plain counterparts."""

from collections import Counter
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
import texts
from hypothesis import given, settings
from hypothesis import strategies as st

from packetlens.llm import graph, jaccard, substrings


def shingles(text, lower=True, width=3):
    w = texts.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") if lower else text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def classes(sets, threshold=90):
    """Smallest id of each group of linked sets; ``sets``: id -> list of sets."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sets, 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= threshold * len(x | y):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {k: find(k) for k in sets}


def check_near(spark, rows, rule=jaccard.JaccardJoin()):
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rule).collect()
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets.setdefault(doc, []).append(shingles(text, width=rule.shingle))
    want = classes(sets, rule.threshold)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter(
        (doc, len(shingles(text, width=rule.shingle)), want.get(doc)) for doc, text in rows)


def near_rows():
    rows, n = [], 100
    for seed in range(12):
        base = texts.prose(seed, 30 + 25 * seed).split()
        for copy in range(6):
            w = list(base)
            for k in range(copy * len(w) // 60):
                w[(k * 17) % len(w)] = f"edit{copy}x{k}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


def test_near_duplicates_by_brute_force(spark):
    check_near(spark, near_rows())


def test_near_duplicates_in_many_small_tiles(spark):
    """One large group of near copies, cut into blocks; the result is the same."""
    base = texts.prose(7, 200).split()
    rows = [(1000 + k, " ".join(base[:k] + [f"own{k}"] + base[k + 1:])) for k in range(60)]
    check_near(spark, near_rows() + rows, jaccard.JaccardJoin(tile_rows=8))
    check_near(spark, rows, jaccard.JaccardJoin(tile_shingles=900))


@pytest.mark.parametrize("prefix", [False, True])
def test_looser_links_by_brute_force(spark, prefix):
    """80 percent of five words, with a passage that most texts share, copies and odd rows; also in small tiles."""
    passage = texts.prose(99, 60)
    shared = [(3000 + k, f"{texts.prose(500 + k, 80)} {passage} {texts.prose(800 + k, 70)}") for k in range(40)]
    base = texts.prose(7, 200).split()
    group = [(1000 + k, " ".join(base[:k] + [f"own{k}"] + base[k + 1:])) for k in range(40)]
    odd = [(r[0], r[1]) for r in texts.odd_rows()]
    rule = jaccard.JaccardJoin(threshold=80, shingle=5, prefix=prefix, sketch_bits=10)
    check_near(spark, near_rows() + shared + odd, rule)
    check_near(spark, near_rows() + shared + group, replace(rule, tile_rows=8))
    assert jaccard.near_duplicates(texts.empty(spark), rule).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([50, 80, 90, 100]), st.integers(0, 2 ** 31))
def test_linked_sets_share_a_first_element(common, left, right, threshold, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    rng.shuffle(pool)
    x, y = np.sort(pool[:common + left]), np.sort(np.r_[pool[:common], pool[500:500 + right]])
    rule = jaccard.JaccardJoin(threshold=threshold, prefix=True, sketch_bits=6)
    ranks = rng.integers(0, 4, 64).astype(np.uint8)
    if 100 * common >= threshold * (common + left + right):
        assert np.intersect1d(jaccard.prefix_keys(x, ranks, rule), jaccard.prefix_keys(y, ranks, rule)).size


def test_shared_passages_are_no_keys(spark):
    """Texts that share a passage and nothing else meet in no key once many of them do."""
    passage = texts.prose(99, 60, 100_000)
    rows = [(k, f"{texts.prose(500 + k, 120, 100_000)} {passage} {texts.prose(5000 + k, 100, 100_000)}") for k in range(300)]
    rule = jaccard.JaccardJoin(threshold=80, shingle=5, prefix=True)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = jaccard.rarity(docs, rule)
    keys = Counter()
    for _, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        (found,) = jaccard.shingle_sets(data, np.array([0, len(data)]), rule)
        keys.update(jaccard.prefix_keys(found, ranks, rule).tolist())
    assert max(keys.values()) < 20


def test_near_duplicates_odd_rows(spark):
    rows = [(r[0], r[1]) for r in texts.odd_rows()]
    check_near(spark, rows)
    found = jaccard.near_duplicates(texts.odd(spark)).collect()
    assert len(found) == len(rows)
    assert jaccard.near_duplicates(texts.empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 2 ** 31))
def test_linked_sets_share_a_part(common, left, right, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    rng.shuffle(pool)
    x, y = np.sort(pool[:common + left]), np.sort(np.r_[pool[:common], pool[500:500 + right]])
    rule = jaccard.JaccardJoin()
    if 100 * common >= 90 * (common + left + right):
        assert np.intersect1d(jaccard.part_keys(x, rule), jaccard.part_keys(y, rule)).size
    assert jaccard.overlap(x, y) == common
    assert np.bitwise_count(jaccard.bitmap(x, 256) ^ jaccard.bitmap(y, 256)).sum() <= left + right


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, None)]
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [25, 1 << 17])
def test_files_of_components_follow_the_edges(spark, monkeypatch, limit):
    """Rounds over a few edges write a few files, however many shuffle partitions there are; with more than a task's edges the result is the same."""
    from pathlib import Path

    monkeypatch.setattr(graph, "EDGE_ROWS", limit, raising=False)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    folder = Path(jaccard.workspace.root(spark).removeprefix("file:"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    before = len(list(folder.rglob("part-*")))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {r.node: r.label for r in graph.components(edges).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert len(list(folder.rglob("part-*"))) - before < 2 * 40


def plain_repeats(rows, window):
    count = Counter()
    for _, text in rows:
        w = texts.words(text)
        count.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for doc, text in rows:
        w = texts.words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("rule", [substrings.Repeats(), substrings.Repeats(window=8, seed=3), substrings.Repeats(window=8, seed=3, hot=2)])
def test_repeats_by_brute_force(spark, rule):
    passage = texts.prose(99, 45)
    rows = [(r[0], r[1]) for r in texts.odd_rows()]
    rows += [(100 + k, f"{texts.prose(k, 50)} {passage} {texts.prose(k + 50, 30)}") for k in range(8)]
    rows += [(200, " ".join(["again"] * 90)), (201, f"{passage}\n{passage}\tend"), (202, texts.prose(3, 34)), (203, texts.prose(3, 35))]
    found = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rule).collect()
    assert Counter(tuple(r) for r in found) == plain_repeats(rows, rule.window)


def test_repeats_odd_tables(spark):
    assert substrings.drop_repeats(texts.odd(spark)).count() == len(texts.odd_rows())
    assert substrings.drop_repeats(texts.empty(spark)).count() == 0


def test_sliding_min_and_super_kmers_cover_all_windows():
    rule = substrings.Repeats(window=6, seed=2)
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 12, 300).astype(np.uint64)
    first = np.array([0, 4, 4, 50, 56, 57, 200, 300])
    seeds, least = substrings.minimisers(hashes, first, rule)
    row, start, stop, value = substrings.super_kmers(least, first, rule)
    seen = [(r, s + k) for r, s, e in zip(row, start, stop, strict=True) for k in range(e - s - rule.window + 1)]
    assert sorted(seen) == [(r, k) for r in range(7) for k in range(max(0, first[r + 1] - first[r] - 5))]
    for r, s, e, v in zip(row, start, stop, value, strict=True):
        for k in range(s, e - 5):
            assert seeds[first[r] + k:first[r] + k + 5].min() == v


@pytest.mark.parametrize("rule", [jaccard.JaccardJoin(), jaccard.JaccardJoin(threshold=80, shingle=5)])
def test_bitmaps_rule_out_no_link(rule):
    """Every linked pair of different pieces, and of different sides, is among the sets that bit counts leave."""
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (3, 40, 700, 705, 6000)]
    sets = []
    for found in base:
        for share in (0.0, 0.02, 0.05, 0.1, 0.3):
            part = found.copy()
            part[:int(share * len(part))] = rng.integers(0, 1 << 63, int(share * len(part)))
            sets.append(np.unique(part))
    sets += [rng.integers(0, 1 << 63, 300).astype(np.uint64) for _ in range(40)]
    sets = [np.unique(x) for x in sets]
    maps = [jaccard.bitmap(x, jaccard.map_bits(len(x), rule)) for x in sets]
    sizes, n = np.array([len(x) for x in sets]), len(sets)
    linked = {(i, j) for i in range(n) for j in range(i) if 100 * (c := jaccard.overlap(sets[i], sets[j])) >= rule.threshold * (sizes[i] + sizes[j] - c)}
    for sides, piece in ((None, np.arange(n)), (np.arange(n) % 2, np.arange(n)), (None, np.arange(n) // 2)):
        kept = jaccard.hopeful(maps, sizes, rule, sides, piece)
        wanted = {k for i, j in linked if piece[i] != piece[j] and (sides is None or sides[i] != sides[j]) for k in (i, j)}
        assert wanted and wanted <= set(np.flatnonzero(kept).tolist())
        assert not kept[-40:].any()


def test_tiles_of_a_large_component_follow_its_shared_parts(spark):
    """A chain of sets is one component; its sets meet their neighbours and not all others."""
    def placed(n):
        edges = spark.createDataFrame([(k, k + 1, k, True) for k in range(n - 1)], "part long, a long, b long, opens boolean")
        members = spark.createDataFrame([(k, 0, 100, k) for k in range(n)], "node long, label long, n_shingles long, set_id long")
        pieces = spark.createDataFrame([], "node long, label long")
        return jaccard._open_tiles(edges, members, pieces, jaccard.JaccardJoin(tile_rows=8)).count()

    assert placed(40) == 2 * 39 and placed(160) == 2 * 159


def test_parts_with_the_same_sets_are_one_tile(spark):
    """Two long sets that share 400 parts, and three sets that share 200 of their own and one with them."""
    parts = [(k, [1, 2]) for k in range(400)] + [(1000 + k, [3, 4, 5]) for k in range(200)] + [(5000, [1, 2, 3, 4, 5]), (5001, [1, 3]), (5002, [2, 4])]
    edges = spark.createDataFrame([(p, a, nodes[0], k == 0) for p, nodes in parts for k, a in enumerate(nodes[1:])], "part long, a long, b long, opens boolean")
    members = spark.createDataFrame([(k, 100, k) for k in range(1, 6)], "node long, n_shingles long, set_id long")
    pieces = spark.createDataFrame([], "node long, label long")
    tiles = {}
    for r in jaccard._open_tiles(edges, members, pieces, jaccard.JaccardJoin()).collect():
        tiles.setdefault(r.tile, []).append(r.node)
    assert sorted(sorted(nodes) for nodes in tiles.values()) == [[1, 2], [1, 2, 3, 4, 5], [1, 3], [2, 4], [3, 4, 5]]


def test_keys_return_in_small_batches(monkeypatch):
    """A few long sets have more keys than a batch, or than a task holds; none is lost."""
    import pyarrow as pa

    long = [" ".join(f"w{k}x{i}" for i in range(40_000)) for k in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(long, pa.string())], ["doc_id", "text"])
    rule = jaccard.JaccardJoin(threshold=80, shingle=5, prefix=True)
    solve = jaccard._key_rows(rule, np.zeros(1 << rule.sketch_bits, np.uint8))
    for held in (1 << 20, 1 << 14):
        monkeypatch.setattr(jaccard, "HELD_KEYS", held)
        found = [(len(b), set(b.column("node").to_pylist())) for b in solve(iter([batch]))]
        assert sum(n for n, _ in found) == 12 * (39_996 - -(-80 * 39_996 // 100) + 1) and max(n for n, _ in found) <= 1 << 16
        assert set().union(*(nodes for _, nodes in found)) == set(range(12))


def edited(k, words, edits):
    """A copy of ``words`` with that many of them replaced, at places of its own."""
    rng, out = np.random.default_rng(k), list(words)
    for at in rng.choice(len(words), edits, replace=False):
        out[at] = f"own{k}x{at}"
    return " ".join(out)


def test_rows_follow_a_group_of_near_copies(spark, monkeypatch):
    """Copies that meet in many parts and are not linked: no step makes more rows than the parts have sets."""
    base, plain, counts = texts.prose(7, 200).split(), jaccard.workspace.written, {}

    def counted(df, name):
        out = plain(df, name)
        counts[name] = max(out.count(), counts.get(name, 0))
        return out

    monkeypatch.setattr(jaccard.workspace, "written", counted)
    rows = [(k, edited(k, base, 6)) for k in range(300)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.JaccardJoin(tile_rows=8)).collect()
    assert all(r.doc_id == r.component_id for r in found)
    assert max(counts.values()) <= 2 * counts["near_edges"] < 300 * 299 / 2


@pytest.mark.parametrize("rule", [
    jaccard.JaccardJoin(tile_rows=8, map_rows=8), jaccard.JaccardJoin(threshold=80, shingle=5, prefix=True, sketch_bits=10, tile_rows=4, map_rows=16)])
def test_groups_around_the_threshold_in_blocks(spark, rule):
    """Copies of which some are linked, some nearly, some with several texts to a doc_id; parts are cut into blocks for bitmaps and for texts."""
    base = texts.prose(7, 150).split()
    rows = [(k - k % 10 // 9, edited(k, base, k % 7)) for k in range(90)] + [(500 + k, edited(k, base[:140], 3 + k % 3)) for k in range(30)]
    check_near(spark, rows, rule)


@pytest.mark.parametrize("limit", [8, 1 << 20])
def test_pairs_of_parts_and_blocks_by_brute_force(limit):
    """Pairs of tiles that batches cut anywhere: matching sizes, other pieces, other sides."""
    import pyarrow as pa

    rng, rule = np.random.default_rng(3), jaccard.JaccardJoin(threshold=80)
    rows = sorted((t, int(z), int(k), int(p), s) for k, (t, z, p, s) in enumerate(zip(
        rng.integers(0, 30, 400).tolist(), rng.integers(50, 100, 400), rng.integers(0, 4, 400), [-1] * 400)))
    rows = [(t, z, k, p, k % 2 if t % 2 else -1) for t, z, k, p, s in rows]
    tile, size, node, piece, side = map(list, zip(*rows))
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (tile, node, size, piece, side)], ["tile", "node", "n_shingles", "piece", "side"])
    batches = [whole.slice(k, limit) for k in range(0, len(rows), limit)]
    found = Counter(pair for b in jaccard._tile_pairs(rule)(iter(batches)) for pair in zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    want = Counter((min(x[2], y[2]), max(x[2], y[2])) for x, y in combinations(rows, 2) if x[0] == y[0] and x[3] != y[3]
                   and 100 * min(x[1], y[1]) >= 80 * max(x[1], y[1]) and (x[4] < 0 or x[4] != y[4]))
    assert want and found == want
