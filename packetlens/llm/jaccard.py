"""Near-duplicate links between shingle sets: Jaccard similarity of at least ``threshold`` percent.

Method: size-banded tiles with hashed bitmap signatures. Bit counts bound the overlap of two sets from
above; only pairs that pass the bound get an exact intersection of their sorted arrays.

1. ``part_keys`` cuts the hash space of a size band into more parts than two linked sets can differ
   in, so linked sets agree on a whole part (nothing is lost). One row per set and part is
   shuffled by part content; copies are merged per task before that.
   With ``prefix`` the keys are instead the first elements of each set, as many as a linked set may lack and one more, in one
   order for all sets: rare ones first by a sketch of fixed size that counts in how many texts hashes stand. Linked sets
   share one of them whatever the sketch says, and it keeps passages that many texts share from being keys. Below 90 percent
   parts would be so small that such passages meet in them.
2. Parts shared by different sets hold every link.
3. Leaders: every set is compared with the set it shares most first parts with. This is linear, and
   connects most of a large group of near copies.
4. Only parts with sets from different connected pieces are left, one of those with the same sets. Such a part is a tile: numpy compares sizes and bitmaps
   there, a few dozen bytes a set, and leaves at most one row for each set, with its likeliest partner from another piece.
   The best partner over all tiles is verified, pieces merge, and the sets that still have a possible link go on, as long as rounds connect many.
5. What then passes the bitmaps is compared by text, each pair in the smallest of the tiles in which both sets stand (told by the first
   tiles of each set), so a text travels to few tiles and pairs never become rows. There numpy compares bitmaps, then
   arrays, and skips pairs already connected. The verified links (less than one per set and tile) are contracted to classes.
6. Tiles have limits, larger ones for bitmaps (``map_rows``) than for texts (``tile_rows``, ``tile_shingles``). One beyond them is cut by
   size band and hash into blocks, and pairs of blocks whose sizes can match are tiles, none of them within the part's largest piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import workspace
from . import tokens
from .graph import components

BAND_STEP = 1.5
BROADCAST_ROWS = 1 << 19  # of 8-byte ids; more are joined by a shuffle
HELD_KEYS, KEY_ROWS = 1 << 20, 1 << 16  # in a task at once, and in one batch that it returns; a long set has thousands
FIRST_PLACES = 16  # of a set, by which a tile tells that it has met a partner before; beyond them a pair may be compared again


@dataclass(frozen=True)
class JaccardJoin:
    """Settings: linked when 100 * intersection >= ``threshold`` * union of word shingles."""

    threshold: int = 90
    shingle: int = 3
    lower: bool = True
    tile_rows: int = 1024
    tile_shingles: int = 1_000_000
    map_rows: int = 4096
    prefix: bool = False
    sketch_bits: int = 21

    def most_differing(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
        # i >= t u and i + u = total give u <= total / (1 + t); the difference is 2 u - total
        union = 100 * total // (100 + self.threshold)
        return max(0, 2 * union - total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, rule: JaccardJoin) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than a shingle count as one shingle."""
    if rule.lower:
        data = tokens.lower_ascii(data)
    words = tokens.split_words(data, offsets)
    hashes = words.hashes()
    wide = tokens.joined_hashes(hashes, rule.shingle, seed=rule.shingle)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= rule.shingle:
            out.append(np.unique(wide[a:b - rule.shingle + 1]))
        else:
            out.append(tokens.joined_hashes(hashes[a:b], b - a, seed=b - a) if b > a else hashes[:0])
    return out


def _band(n: int) -> int:
    band = int(math.log(n) / math.log(BAND_STEP))
    while BAND_STEP ** (band + 1) <= n:
        band += 1
    while BAND_STEP ** band > n:
        band -= 1
    return band


def part_keys(found: np.ndarray, rule: JaccardJoin) -> np.ndarray:
    """Hashes of the parts of one sorted set, for its own size band and, if a smaller partner may be there, the one below."""
    n = len(found)
    out = []
    top = _band(n)
    for band in (top, top - 1):
        upper = math.ceil(BAND_STEP ** (band + 1)) - 1  # largest size of the band
        smallest = -(-rule.threshold * n // 100)        # of a linked set
        if band < 0 or upper < smallest or n * rule.threshold > 100 * upper:
            continue
        # a set of the band and any partner that may be linked with it
        differing = rule.most_differing(upper + 100 * upper // rule.threshold)
        # below 90 percent parts are smaller and more of them empty; spare ones keep sets from meeting by empty parts
        spare = 1 + (differing // 8 if rule.threshold >= 90 else differing // 4 + math.isqrt(differing))
        parts = differing + 1 + spare
        seed = np.uint64(band * 1_000_003 + 17)
        place = (((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.diff(place, prepend=-1))
        sums = np.add.reduceat(tokens.mix(found + seed), edge)
        count = np.diff(edge, append=n).astype(np.uint64)
        full = place[edge]
        out.append(tokens.mix(sums ^ tokens.mix(full.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count + seed)))
        if parts - len(full) > spare:  # so many empty parts that linked sets may agree on nothing else
            empty = np.setdiff1d(np.arange(parts), full).astype(np.uint64)
            out.append(tokens.mix(tokens.mix(empty * np.uint64(0x9E3779B97F4A7C15) + seed)))
    return np.unique(np.concatenate(out)) if out else found[:0]


def prefix_keys(found: np.ndarray, ranks: np.ndarray, rule: JaccardJoin) -> np.ndarray:
    """The first elements of a sorted set by (rank, hash): at most so many can be missing in a linked set, and one more."""
    n = len(found)
    first = np.argsort(ranks[_cells(found, rule)], kind="stable")[:n - -(-rule.threshold * n // 100) + 1]
    return tokens.mix(found[first])


def _cells(found: np.ndarray, rule: JaccardJoin) -> np.ndarray:
    return (found >> np.uint64(64 - rule.sketch_bits)).astype(np.int64)


_BLOCK = 1 << 16  # cells of the sketch that are added up together


def _sketch_rows(rule: JaccardJoin) -> Callable:
    """How often hashes of each cell stand in a task's sets; equal sets of a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << rule.sketch_bits
        total = np.zeros(size, np.int64)
        for batch in batches:
            seen = set()
            for _, _, data, offsets in tokens.chunks(batch.column("text")):
                fresh = []
                for found in shingle_sets(data, offsets, rule):
                    name = _identity(found)
                    if name not in seen:
                        seen.add(name)
                        fresh.append(found)
                total += np.bincount(_cells(np.concatenate(fresh), rule), minlength=size) if fresh else 0
        step = min(size, _BLOCK)
        for k in range(0, size, step):
            part = np.minimum(total[k:k + step], (1 << 32) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])
    return run


def _ranked(table: pa.Table) -> pa.Table:
    """Sums of a block of cells as ranks: a step for each doubling."""
    total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist())
    ranks = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
    return pa.table({"block": table.column("block").slice(0, 1), "ranks": pa.array([ranks.tobytes()], pa.binary())})


def rarity(docs: DataFrame, rule: JaccardJoin) -> np.ndarray:
    """The rank of each cell of hashes; 2^sketch_bits bytes, whatever the data."""
    out = np.zeros(1 << rule.sketch_bits, np.uint8)
    found = docs.mapInArrow(_sketch_rows(rule), "block int, counts binary").groupBy("block").applyInArrow(_ranked, "block int, ranks binary")
    step = min(len(out), _BLOCK)
    for r in found.collect():
        out[r["block"] * step:(r["block"] + 1) * step] = np.frombuffer(r["ranks"], np.uint8)
    return out


def _identity(found: np.ndarray) -> int:
    """One number for a whole set."""
    return int(tokens.mix(np.array([found.sum(dtype=np.uint64)]) ^ tokens.mix(np.array([len(found)], np.uint64)))[0])


def _long(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


SETS = "doc_id long, n_shingles long, set_id long, map binary"
KEYS = "part long, set_id long, node long"


def _set_rows(rule: JaccardJoin) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tokens.chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, rule)
                ids = np.array([_identity(s) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(_long(ids)),
                     pa.array([bitmap(s, map_bits(len(s), rule)).tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "set_id", "map"])
    return run


def _key_rows(rule: JaccardJoin, ranks: np.ndarray | None = None) -> Callable:
    """A row for each set and key; copies are merged among sets of about ``HELD_KEYS`` keys."""

    def rows(arrays: dict[int, np.ndarray], seen: dict[int, int]) -> Iterator[pa.RecordBatch]:
        sizes = [len(arrays[k]) for k in seen]
        keys = pa.RecordBatch.from_arrays(
            [pa.array(_long(np.concatenate([arrays[k] for k in seen]))),
             pa.array(np.repeat(_long(list(seen)), sizes)), pa.array(np.repeat(np.array(list(seen.values()), np.int64), sizes))],
            ["part", "set_id", "node"])
        for k in range(0, len(keys), KEY_ROWS):  # the executor holds a batch as a whole
            yield keys.slice(k, KEY_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, int] = {}
            arrays: dict[int, np.ndarray] = {}
            held = 0
            ids = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in tokens.chunks(batch.column("text")):
                for doc, found in zip(ids[a:b], shingle_sets(data, offsets, rule), strict=True):
                    if len(found) and doc is not None:
                        name = _identity(found)
                        if name not in arrays:
                            arrays[name] = part_keys(found, rule) if ranks is None else prefix_keys(found, ranks, rule)
                            held += len(arrays[name])
                        seen[name] = min(doc, seen.get(name, doc))
                if held > HELD_KEYS:
                    yield from rows(arrays, seen)
                    seen, arrays, held = {}, {}, 0
            if seen:
                yield from rows(arrays, seen)
    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by part, set and node: edges of the sets of each part to its first set; constant memory.

    ``opens`` marks the first edge of a part.
    """
    part = first = last = None
    opened = False
    for batch in batches:
        p, s, n = (batch.column(c).to_numpy() for c in ("part", "set_id", "node"))
        if not len(p):
            continue
        new_part = np.r_[p[0] != part, p[1:] != p[:-1]]
        new_set = new_part | np.r_[s[0] != last, s[1:] != s[:-1]]
        # nodes are ascending within a set, so its first row has the smallest, the set's representative
        group = np.cumsum(new_part)
        heads = np.r_[first if first is not None else 0, n[new_part]]
        head = heads[group]
        keep = new_set & ~new_part
        own = group[keep]
        opens = np.diff(own, prepend=0 if opened else -1) != 0
        opened = bool((own == group[-1]).any()) or (opened and group[-1] == 0)
        part, last, first = p[-1], s[-1], head[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(p[keep]), pa.array(n[keep]), pa.array(head[keep]), pa.array(opens)], ["part", "a", "b", "opens"])


def bitmap(found: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the elements hashed to each bit: two bitmaps differ in at most as many bits as the sets in elements."""
    flips = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def map_bits(n: int, rule: JaccardJoin) -> int:
    """Bits of the bitmap of a set: about four for each element that a linked set of its size may differ in."""
    bits = 256
    while bits < 4 * rule.most_differing(2 * n):
        bits *= 2
    return bits


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer 64-bit words: parities of the bits that fall together."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def hopeful(maps: list[np.ndarray], sizes: np.ndarray, rule: JaccardJoin, left: np.ndarray | None, piece: np.ndarray) -> np.ndarray:
    """Which sets of a tile have a partner, in another piece and on the other side if there are sides, that bit counts allow."""
    n = len(maps)
    order = np.lexsort((np.arange(n), sizes))
    sizes, piece = sizes[order], piece[order]
    side = None if left is None else left[order]
    words = np.array([len(maps[i]) for i in order])  # ascending, as the sizes are
    held: dict[int, np.ndarray] = {}
    found = np.zeros(n, bool)
    for i in range(n):
        size, end = int(sizes[i]), int(np.searchsorted(sizes, 100 * int(sizes[i]) // rule.threshold, "right"))
        if end <= i + 1:
            continue
        width = int(words[i])
        if width not in held:  # of all sets with bitmaps at least as wide
            begin = int(np.searchsorted(words, width))
            parts = [folded(np.stack([maps[k] for k in order[a:b]]), width) for a, b in _equal_runs(words, begin)]
            held = {width: np.concatenate([np.zeros((begin, width), np.uint64), *parts])}
        others = np.arange(i + 1, end)
        others = others[piece[i + 1:end] != piece[i]]
        if side is not None:
            others = others[side[others] != side[i]]
        total = sizes[others] + size
        most = (total - np.bitwise_count(held[width][others] ^ held[width][i]).sum(axis=1, dtype=np.int64)) // 2
        passed = others[100 * most >= rule.threshold * (total - most)]
        if len(passed):
            found[order[i]] = True
            found[order[passed]] = True
    return found


def _equal_runs(values: np.ndarray, begin: int) -> list[tuple[int, int]]:
    edges = begin + np.flatnonzero(np.diff(values[begin:], prepend=-1))
    return list(zip(edges.tolist(), [*edges[1:].tolist(), len(values)], strict=True))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def linked_pairs(
    sets: list[np.ndarray], rule: JaccardJoin, left: np.ndarray | None = None, piece: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a tile; pairs already connected are not compared again.

    ``left`` (0 or 1 for each set): only pairs from different sides are compared, for a tile of two blocks.
    ``piece``: sets with the same number are connected from the start.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.arange(n), sizes))
    bits = map_bits(int(sizes.max(initial=0)), rule)
    maps = np.array([bitmap(sets[i], bits) for i in order])
    sorted_sizes = sizes[order]
    side = None if left is None else left[order]
    root = np.arange(n)
    if piece is not None:
        _, head, which = np.unique(piece[order], return_index=True, return_inverse=True)
        root = head[which]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n):
        size = int(sorted_sizes[i])
        if not size:
            continue
        end = int(np.searchsorted(sorted_sizes, 100 * size // rule.threshold, "right"))
        if end <= i + 1:
            continue
        others = np.arange(i + 1, end)
        if side is not None:
            others = others[side[i + 1:end] != side[i]]
        differing = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        total = sorted_sizes[others] + size
        most = (total - differing) // 2  # the intersection is no larger
        for j in others[100 * most >= rule.threshold * (total - most)]:
            j = int(j)
            if find(i) == find(j):
                continue
            common = overlap(sets[order[i]], sets[order[j]])
            if 100 * common >= rule.threshold * (size + int(sorted_sizes[j]) - common):
                root[find(j)] = find(i)
                out.append((int(order[i]), int(order[j])))
    return out


def _tile_hopes(rule: JaccardJoin) -> Callable:
    """From bitmaps sorted by tile: the rows of the sets that may have a link."""
    names = ["tile", "node", "side", "piece"]

    def solve(rows: list) -> Iterator[pa.RecordBatch]:
        node, side, piece, sizes, maps = zip(*(r[1:] for r in rows), strict=True)
        side, piece = np.array(side), np.array(piece)
        keep = hopeful([np.frombuffer(m, np.uint64) for m in maps], np.array(sizes), rule, None if (side < 0).all() else side, piece)
        if keep.any():
            kept = [np.full(int(keep.sum()), rows[0][0]), np.array(node)[keep], side[keep], piece[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in kept], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*names, "n_shingles", "map"]), strict=True):
                if rows and row[0] != rows[0][0]:
                    if len(rows) > 1:
                        yield from solve(rows)
                    rows = []
                rows.append(row)
        if len(rows) > 1:
            yield from solve(rows)
    return run


def _tile_links(rule: JaccardJoin) -> Callable:
    def solve(rows: list) -> list[tuple[int, int]]:
        sets: list[np.ndarray] = []
        text = pa.array([r[1] for r in rows], pa.large_string())
        for _, _, data, offsets in tokens.chunks(text):
            sets += shingle_sets(data, offsets, rule)
        sides = np.array([r[2] for r in rows])
        pairs = linked_pairs(sets, rule, None if (sides < 0).all() else sides, np.array([r[3] for r in rows]))
        return [(rows[i][0], rows[j][0]) for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, out = None, [], []
        for batch in batches:
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "node", "text", "side", "piece")), strict=True):
                if t != tile:
                    out += solve(rows) if len(rows) > 1 else []
                    tile, rows = t, []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        out += solve(rows) if len(rows) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
    return run


def _cut(rows: Column, shingles: Column, rule: JaccardJoin) -> Column:
    """Into how many blocks sets are cut; two blocks keep within the limits of a tile."""
    return F.ceil(F.greatest(rows / rule.tile_rows, shingles / rule.tile_shingles) * 2).cast("long")


def _leader_tiles(stars: DataFrame, members: DataFrame, rule: JaccardJoin) -> DataFrame:
    """(node, tile, side, piece): every set with the one it shares most parts with as their first set."""
    led = stars.groupBy(F.col("a").alias("node")).agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("leader"))
    return _led_tiles(led.join(members, "node"), rule)


def _led_tiles(led: DataFrame, rule: JaccardJoin) -> DataFrame:
    """(node, tile, side, piece) for (node, leader, n_shingles): every leader with its followers, cut if they are many."""
    cuts = led.groupBy("leader").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles")).select(
        "leader", _cut(F.col("rows"), F.col("shingles"), rule).alias("cut"))
    followers = led.join(cuts, "leader").select(
        "node", F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.col("cut"))).alias("tile"), F.lit(1).alias("side"))
    leaders = cuts.select(F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("k")).select(
        "node", F.xxhash64("node", "k").alias("tile"), F.lit(0).alias("side"))
    return followers.unionByName(leaders).withColumn("piece", F.col("node"))


def _with_pieces(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with the connected piece of each node; a node without links is its own."""
    return rows.join(pieces.withColumnRenamed("label", "piece"), "node", "left").withColumn("piece", F.coalesce("piece", "node"))


def _open_tiles(edges: DataFrame, members: DataFrame, pieces: DataFrame, rule: JaccardJoin) -> DataFrame:
    """(node, tile, side, piece) for the sets of each part that joins several connected pieces; side -1: all pairs of the tile count.

    Long sets share many parts with the same few others; of the parts with the same sets one is a tile.
    """
    held = edges.select("part", F.col("a").alias("node")).unionByName(edges.where("opens").select("part", F.col("b").alias("node")))
    met = workspace.written(held.join(_with_pieces(members.select("node", "n_shingles"), pieces), "node"), "near_met")
    # sets of a part are told by their number and the sum of their hashes, in halves as it has more than 64 bits
    name = F.xxhash64("node", "n_shingles")
    sums = [F.sum(name.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"), F.sum(F.shiftrightunsigned(name, 32)).alias("high")]
    shared = met.groupBy("part").agg(F.min("piece").alias("least"), F.max("piece").alias("most"), F.count("*").alias("rows"), *sums).where("least <> most")
    shared = shared.groupBy("rows", "low", "high").agg(F.min("part").alias("part"))
    # a bitmap is a small part of its text
    wide = replace(rule, tile_rows=rule.map_rows, tile_shingles=rule.tile_shingles * 16)
    # few of the rows are left, and several branches read them
    return _fitted(workspace.written(met.join(shared.select("part"), "part"), "near_open"), wide)


def _fitted(met: DataFrame, rule: JaccardJoin) -> DataFrame:
    """(node, tile, side, piece): each part of (part, node, piece, n_shingles) is a tile; one beyond the limits is cut into blocks."""
    sizes = met.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"))
    fits = (F.col("rows") <= rule.tile_rows) & (F.col("shingles") <= rule.tile_shingles)
    large = sizes.where(~fits).select("part")
    few = met.join(large, "part", "left_anti").select("node", F.col("part").alias("tile"), F.lit(-1).alias("side"), "piece")
    return few.unionByName(_blocks(met.join(large, "part"), rule))


def _blocks(met: DataFrame, rule: JaccardJoin) -> DataFrame:
    """Rows of parts that many sets share, in tiles of two blocks, none of them within the part's largest piece."""
    # linked sizes differ by less than one step of this base, so they are in the same or in adjacent bands
    step = math.log(100 / rule.threshold) * 1.0001 if rule.threshold < 100 else 1.0
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / step)
    largest = met.groupBy("part", "piece").agg(F.count("*").alias("rows")).groupBy("part").agg(
        F.max_by("piece", F.struct("rows", -F.col("piece"))).alias("most"))
    large = met.join(largest, "part").select(
        "part", "node", "piece", "n_shingles", band.alias("band"), (F.col("piece") == F.col("most")).alias("main"))
    cuts = large.groupBy("part", "band", "main").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles")).select(
        "part", "band", "main", _cut(F.col("rows"), F.col("shingles"), rule).alias("cut"))
    mine = large.join(cuts, ["part", "band", "main"]).select(
        "node", "part", "piece", F.struct("band", "main", F.pmod(F.xxhash64("node"), F.col("cut")).alias("k")).alias("own"))
    around = mine.withColumn("near_band", F.explode(F.array(*[F.col("own.band") + d for d in (-1, 0, 1)])))
    other = cuts.select("part", F.col("band").alias("near_band"), F.col("main").alias("near_main"), "cut")
    met = around.join(other, ["part", "near_band"]).where("not (own.main and near_main)").withColumn(
        "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    block = F.struct(F.col("near_band").alias("band"), F.col("near_main").alias("main"), "k")
    met = met.withColumn("block", block).withColumn("low", F.least("own", "block")).withColumn("high", F.greatest("own", "block"))
    return met.select(
        "node", F.xxhash64("part", "low", "high").alias("tile"),
        F.when(F.col("low") == F.col("high"), -1).when(F.col("own") == F.col("low"), 0).otherwise(1).alias("side"), "piece")


def _whole_tiles(solve: Callable) -> Callable:
    """From rows sorted by tile: ``solve`` gets tables of whole tiles, many small ones at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            tile = batch.column("tile").to_numpy()
            begin = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
            if begin or (held and held[0].column("tile")[0].as_py() != tile[0]):
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from solve(pa.Table.from_batches(held))
    return run


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def _folds(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Words of each bitmap, and by width the bitmaps at least as wide, folded, with the place of each row."""
    column = column.cast(pa.large_binary()).combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.uint64)
    starts, words = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8
    whole = {}
    for wide in np.unique(words).tolist():
        rows = np.flatnonzero(words == wide)
        whole[wide] = rows, data[starts[rows][:, None] + np.arange(wide)]
    out = {}
    for width in whole:
        wider = [w for w in whole if w >= width]
        place = np.zeros(len(words), np.int64)
        rows = np.concatenate([whole[w][0] for w in wider])
        place[rows] = np.arange(len(rows))
        out[width] = place, np.concatenate([folded(whole[w][1], width) for w in wider])
    return words, out


def _matches(table: pa.Table, rule: JaccardJoin) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a tile, of different pieces, and sides if there are, whose sizes and bitmaps if there are allow a link.

    Rows are sorted by tile and size. Also yields the largest similarity that a pair may have, in millionths.
    No row comes twice on either side of a step.
    """
    tile, size, node, piece, side = _numbers(table, "tile", "n_shingles", "node", "piece", "side")
    words, folds = _folds(table.column("map")) if "map" in table.column_names else (None, {})
    at, apart = np.arange(len(tile)), 0
    while len(at):
        apart += 1
        at = at[at + apart < len(tile)]
        on = at + apart
        # sizes ascend within a tile: a row that has met one too large meets no more
        near = (tile[at] == tile[on]) & (100 * size[at] >= rule.threshold * size[on])
        at, on = at[near], on[near]
        kept = (piece[at] != piece[on]) & ((side[at] != side[on]) | (side[at] < 0)) & (node[at] != node[on])
        x, y = at[kept], on[kept]
        total, most = size[x] + size[y], size[x]
        if words is not None:
            width, differing = np.minimum(words[x], words[y]), np.zeros(len(x), np.int64)
            for w in np.unique(width).tolist():
                rows, (place, maps) = np.flatnonzero(width == w), folds[w]
                differing[rows] = np.bitwise_count(maps[place[x[rows]]] ^ maps[place[y[rows]]]).sum(axis=1, dtype=np.int64)
            most = (total - differing) // 2
        passed = 100 * most >= rule.threshold * (total - most)
        if passed.any():
            yield x[passed], y[passed], (1_000_000 * most // (total - most))[passed]


def _tile_pairs(rule: JaccardJoin) -> Callable:
    """From rows sorted by tile and size: all pairs that ``_matches`` leaves, as rows."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = _numbers(table, "node", "n_shingles", "piece")
        for x, y, _ in _matches(table, rule):
            x, y = np.where(columns[0][x] < columns[0][y], x, y), np.where(columns[0][x] < columns[0][y], y, x)
            yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in columns for k in (x, y)], ["a", "b", "a_size", "b_size", "a_piece", "b_piece"])
    return _whole_tiles(solve)


PLACES = ["tile", "node", "side", "piece", "n_shingles"]


def _tile_partners(rule: JaccardJoin) -> Callable:
    """From rows sorted by tile and size: those with a possible link, each with its likeliest partner in the tile."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).max
        best = np.full(len(table), none)  # what lacks to full similarity, then the partner's row
        for x, y, like in _matches(table, rule):
            lack = (1_000_000 - like) << 32
            best[x] = np.minimum(best[x], lack + y)
            best[y] = np.minimum(best[y], lack + x)
        kept = np.flatnonzero(best < none)
        if len(kept):
            columns = _numbers(table, *PLACES)
            rows = [c[kept] for c in columns] + [columns[1][best[kept] & ((1 << 32) - 1)], best[kept] >> 32]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], [*PLACES, "partner", "lack"])
    return _whole_tiles(solve)


def _tile_meets(rule: JaccardJoin) -> Callable:
    """From rows sorted by tile and size, with the first ``places`` (tile, side) of each set: those with a possible link to a set met in none of them before."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = _numbers(table, *PLACES)
        places = table.column("places").combine_chunks()
        owner = np.repeat(np.arange(len(table)), places.value_lengths().to_numpy())
        flat, on_side = (c.to_numpy() for c in places.flatten().flatten())
        earlier = flat < columns[0][owner]
        on_side = on_side[earlier].astype(np.int64)
        owner, (names, flat) = owner[earlier], np.unique(flat[earlier], return_inverse=True)
        flat = flat.astype(np.int64)
        known = np.sort((owner * len(names) + flat) * 3 + on_side + 1)
        other_side = np.where(on_side < 0, 0, 2 - on_side)  # where a partner stands
        first = np.searchsorted(owner, np.arange(len(table) + 1))
        marked = np.zeros(len(table), bool)
        for x, y, _ in _matches(table, rule):
            n = first[x + 1] - first[x]
            pair = np.repeat(np.arange(len(x)), n)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[x][pair]
            asked = (y[pair] * len(names) + flat[place]) * 3 + other_side[place]
            at = np.searchsorted(known, asked)
            at[at == len(known)] = 0
            fresh = np.bincount(pair[known[at] == asked], minlength=len(x)) == 0 if len(known) else np.ones(len(x), bool)
            marked[x[fresh]] = marked[y[fresh]] = True
        if marked.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[marked]) for c in columns], PLACES)
    return _whole_tiles(solve)


def near_duplicates(docs: DataFrame, rule: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``component_id`` is the smallest doc_id that links lead to, the row's own included. Null and
    empty texts have no shingles and no links. Rows with equal sets are one class whatever their
    number. Rows without doc_id are returned with a null component and link nothing; rows that share
    a doc_id are linked with each other's partners. An empty table gives no rows.
    Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = workspace.written(docs.mapInArrow(_set_rows(rule), SETS), "shingle_sets")  # and their bitmaps
    # a set is known by its smallest doc_id
    classes = sets.where("doc_id is not null and n_shingles > 0").groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("node"))
    keys = docs.mapInArrow(_key_rows(rule, rarity(docs, rule) if rule.prefix else None), KEYS)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = keys.repartition(width, "part").sortWithinPartitions("part", "set_id", "node").mapInArrow(
        _stars, "part long, a long, b long, opens boolean")
    edges = workspace.written(edges, "near_edges")
    stars = workspace.written(edges.groupBy("a", "b").agg(F.count("*").alias("n")), "near_stars")
    met = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    members = workspace.written(classes.join(met, "node").select("node", "n_shingles", "set_id"), "near_members")
    texts = docs.where("doc_id is not null and text is not null").withColumnRenamed("doc_id", "node")
    maps = workspace.written(
        sets.select(F.col("doc_id").alias("node"), "set_id", "map").join(members.select("node", "set_id", "n_shingles"), ["node", "set_id"])
        .dropDuplicates(["node", "set_id"]).select("node", "n_shingles", "map"), "near_maps")

    def compared(placed: DataFrame) -> DataFrame:
        rows = maps.join(placed, "node").select("tile", "node", "side", "piece", "n_shingles", "map")
        hopes = rows.repartition(width, "tile").sortWithinPartitions("tile", "node").mapInArrow(
            _tile_hopes(rule), "tile long, node long, side long, piece long").distinct()
        hopes = workspace.written(hopes, "near_hopes")
        nodes = hopes.select("node").distinct()
        few = hopes.count() <= BROADCAST_ROWS  # then the other texts need no shuffle
        rows = texts.join(F.broadcast(nodes) if few else nodes, "node").join(hopes, "node").select("tile", "node", "text", "side", "piece")
        links = rows.repartition(width, "tile").sortWithinPartitions("tile", "node").mapInArrow(_tile_links(rule), "a long, b long")
        return workspace.written(links, "near_links")

    def tiled(rows: DataFrame, solve: Callable, name: str, more: str = "") -> DataFrame:
        rows = rows.repartition(width, "tile").sortWithinPartitions("tile", "n_shingles")
        return workspace.written(rows.mapInArrow(solve, ", ".join(f"{c} long" for c in PLACES) + more), name)

    def partners(placed: DataFrame) -> DataFrame:
        return tiled(placed.join(maps, "node"), _tile_partners(rule), "near_partners", ", partner long, lack long")

    links = compared(_leader_tiles(stars, members, rule))
    pieces = components(links, "a", "b")
    hopes = partners(_open_tiles(edges, members, pieces, rule))
    while True:  # a round leaves at most seven eighths of the sets for the next, or is the last
        likeliest = F.min_by("partner", F.struct("lack", "partner")).alias("leader")
        led = workspace.written(hopes.groupBy("node").agg(likeliest, F.max("n_shingles").alias("n_shingles")), "near_led")
        n = led.count()
        fresh = compared(_led_tiles(led, rule)) if n else links.limit(0)
        n_fresh = fresh.count()
        if n_fresh:
            links = workspace.written(links.unionByName(fresh), "near_linked")
            pieces = components(links, "a", "b")
            hopes = partners(_with_pieces(hopes.select("node", "tile", "side").distinct(), pieces))
        if 8 * n_fresh < n or not n:
            break
    if n:
        placed = hopes.select("node", "tile", "side", "piece").distinct()
        places = placed.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("tile", "side"))), 1, FIRST_PLACES).alias("places"))
        marked = tiled(placed.join(places, "node").join(maps, "node"), _tile_meets(rule), "near_meets")
        links = links.unionByName(compared(_fitted(marked.withColumnRenamed("tile", "part").drop("side"), rule)))
    # a doc_id of several sets ties the classes they are in
    held = sets.where("doc_id is not null and n_shingles > 0").select("doc_id", "set_id")
    several = held.groupBy("doc_id").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).where("least <> most").select("doc_id")
    ties = held.join(several, "doc_id").join(classes, "set_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links.unionByName(ties), "a", "b")
    named = classes.join(found, "node", "left").select("set_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    return sets.drop("map").join(named, ["set_id", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
