"""Exact nearest neighbours between two tables of feature vectors, without comparing all pairs.

Space is cut into cells of similar size by the median splits of a small sample (the sample only
decides where the cuts lie). A query first looks in its own cell, which bounds the distance of its
k-th neighbour, and then in exactly those cells that lie within that distance. Cells with many
points or many queries are cut into blocks, every pair of which is a task group of its own; the
candidates of a query, at most k per block, are merged in the end. Nothing is capped: where a cell has
too few points for a bound, the k-th nearest of a few anchor points is one. The cuts come from a sample of fixed size, so cells grow with very large
tables; inside a group a second tree over its points keeps the cost of a query the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import workspace
from ..schemas import FEATURES

BLOCK = 20_000  # rows of either side that meet in one group
SAMPLE_ROWS = 100_000
LOCAL_ROWS = 200  # points of a cell inside a group
ANCHORS = 2_000  # points that bound a distance where a cell cannot
SMALLEST = 8  # sample rows on either side of a cut
FAIR = 0.25  # share of the rows that makes a cut good enough
POINT = ", ".join(f"{f} double" for f in FEATURES)
FOUND = "qid string, pid string, distance double, weight long"


def vector_id(*columns: Column) -> Column:
    """128 hash bits of a vector."""
    cols = columns or tuple(F.col(f) for f in FEATURES)
    return F.concat(F.hex(F.xxhash64(*cols)), F.hex(F.xxhash64(F.lit(1), *cols)))


class Cells:
    """Median splits: node i is (feature, threshold, left, right), or feature -1 and the cell in ``left``."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.feature, self.threshold, self.left, self.right = feature, threshold, left, right

    def as_lists(self) -> list[list]:
        return [c.tolist() for c in (self.feature, self.threshold, self.left, self.right)]

    @classmethod
    def from_lists(cls, columns: list[list]) -> Cells:
        return cls(*(np.array(c) for c in columns))

    @classmethod
    def cut(cls, sample: np.ndarray, count: int) -> Cells:
        nodes: list[tuple] = [()]
        todo, cells = [(0, sample, count)], 0
        while todo:
            at, x, wanted = todo.pop()
            f, middle = cls._split(x) if wanted > 1 else (-1, 0.0)
            if f < 0:
                nodes[at] = (-1, 0.0, cells, cells)
                cells += 1
                continue
            below = x[:, f] < middle
            left, right = len(nodes), len(nodes) + 1
            nodes += [(), ()]
            nodes[at] = (f, middle, left, right)
            todo += [(left, x[below], wanted // 2), (right, x[~below], wanted - wanted // 2)]
        return cls(*(np.array(c) for c in zip(*nodes)))

    @staticmethod
    def _split(x: np.ndarray) -> tuple[int, float]:
        """The widest feature whose median leaves a fair share on both sides, or else the fairest one."""
        best, share = (-1, 0.0), SMALLEST / max(len(x), 1)
        for f in np.argsort(np.min(x, axis=0) - np.max(x, axis=0)):
            middle = float(np.median(x[:, f]))
            for cut in (middle, float(np.nextafter(middle, np.inf))):
                below = float((x[:, f] < cut).mean())
                if min(below, 1 - below) >= share:
                    best, share = (int(f), cut), min(below, 1 - below) + 1e-12
            if share >= FAIR:
                break
        return best

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        at = np.zeros(len(x), dtype=int)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            lower = x[rows, self.feature[node]] < self.threshold[node]
            at[rows] = np.where(lower, self.left[node], self.right[node])
        return self.left[at]

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs of all cells that may hold a point within ``radius`` of a row."""
        row, at, rows, cells = np.arange(len(x)), np.zeros(len(x), dtype=int), [], []
        while len(row):
            leaf = self.feature[at] < 0
            rows.append(row[leaf])
            cells.append(self.left[at[leaf]])
            row, at = row[~leaf], at[~leaf]
            f, cut = self.feature[at], self.threshold[at]
            value, r = x[row, f], radius[row]
            go_left, go_right = value - r < cut, value + r >= cut
            row, at = np.concatenate([row[go_left], row[go_right]]), np.concatenate([self.left[at[go_left]], self.right[at[go_right]]])
        return np.concatenate(rows), np.concatenate(cells)


def plan_cells(points: DataFrame, cell_rows: int) -> Cells:
    """Cells of about ``cell_rows`` points."""
    total = points.count()
    sample = points.select("pid", *FEATURES).orderBy("pid").limit(SAMPLE_ROWS).toPandas()[FEATURES].to_numpy()
    return Cells.cut(sample, max(1, min(total // cell_rows, len(sample) // 8)))


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(p)))
    for f in range(q.shape[1]):
        step = q[:, f, None] - p[None, :, f]
        total += step * step
    return np.sqrt(total)


def _best(distance: np.ndarray, weight: np.ndarray, ids: np.ndarray, k: int, limit: float) -> np.ndarray:
    """Indexes of the nearest points that together weigh k, in (distance, id) order."""
    k_th = np.partition(distance, k - 1)[k - 1] if len(distance) > k else np.inf
    near = np.flatnonzero(distance <= min(k_th, limit))
    near = near[np.lexsort((ids[near], distance[near]))]
    return near[: int(np.searchsorted(np.cumsum(weight[near]), k)) + 1]


def _near_rows(x: np.ndarray, limits: np.ndarray, p: np.ndarray, k: int) -> list[np.ndarray]:
    """For every query, points among which are all that its k nearest in reach can be, by a tree over the points of a group.

    So the cost of a query does not grow with its group: it looks at the points of its own small cell, which
    bound the k-th distance, and then at those of the cells within that bound.
    """
    tree = Cells.cut(p, len(p) // LOCAL_ROWS)
    home = tree.home(p)
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(home.max() + 2))
    mine, radius = tree.home(x), limits.copy()
    for cell in np.unique(mine):
        asked, offered = np.flatnonzero(mine == cell), order[edges[cell]:edges[cell + 1]]
        if len(offered) > k:  # one of them may be the query itself
            radius[asked] = np.minimum(radius[asked], np.partition(_distances(x[asked], p[offered]), k, axis=1)[:, k])
    row, cell = tree.within(x, radius)
    by_row = np.argsort(row, kind="stable")
    cells = np.split(cell[by_row], np.searchsorted(row[by_row], np.arange(1, len(x))))
    return [np.concatenate([order[edges[c]:edges[c + 1]] for c in own]) if len(own) else order[:0] for own in cells]


def _search(k: int, exclude_self: bool):
    def search(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        hits, distances, weights_out = [], [], []
        x, p = queries[FEATURES].to_numpy(), points[FEATURES].to_numpy()
        ids, weights = points["pid"].to_numpy().astype(str), points["weight"].to_numpy()
        qids, limits = queries["qid"].to_numpy().astype(str), queries["radius"].to_numpy()
        step = max(1, 4_000_000 // max(len(p), 1))
        for start in range(0, len(x) if len(p) else 0, step):
            asked = x[start:start + step]
            small = len(p) <= 4 * LOCAL_ROWS
            block = _distances(asked, p) if small else None
            near = None if small else _near_rows(asked, limits[start:start + step], p, k)
            for i in range(start, start + len(asked)):
                rows = np.arange(len(p)) if small else near[i - start]
                distance = block[i - start] if small else _distances(x[i:i + 1], p[rows])[0]
                weight = weights[rows]
                if exclude_self:
                    weight = weight - (ids[rows] == qids[i])
                    distance = np.where(weight > 0, distance, np.inf)
                best = _best(distance, weight, ids[rows], k, limits[i])
                best = best[weight[best] > 0]
                hits.append(rows[best])
                distances.append(distance[best])
                weights_out.append(weight[best])
        if not hits:
            return pd.DataFrame({"qid": [], "pid": [], "distance": [], "weight": []})
        return pd.DataFrame({
            "qid": np.repeat(queries["qid"].to_numpy()[:len(hits)], [len(h) for h in hits]),
            "pid": points["pid"].to_numpy()[np.concatenate(hits)],
            "distance": np.concatenate(distances), "weight": np.concatenate(weights_out)})

    return search


def _nearest_k(found: DataFrame, k: int) -> DataFrame:
    """The candidates of every query that together weigh k; the last one counts only as far as needed."""
    best = F.array_sort(F.collect_list(F.struct("distance", "pid", "weight")))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<distance:double,pid:string,weight:bigint>>").alias("kept"))

    def take(acc: Column, c: Column) -> Column:
        weight = F.least(c["weight"], F.lit(k) - acc["sum"])
        entry = F.struct(c["distance"].alias("distance"), c["pid"].alias("pid"), weight.alias("weight"))
        return F.when(acc["sum"] >= k, acc).otherwise(F.struct(
            (acc["sum"] + weight).alias("sum"), F.concat(acc["kept"], F.array(entry)).alias("kept")))

    return found.groupBy("qid").agg(F.aggregate(best, start, take)["kept"].alias("kept")).select("qid", F.inline("kept"))


def nearest(queries: DataFrame, points: DataFrame, cells: Cells, k: int, exclude_self: bool) -> DataFrame:
    """(qid, pid, distance, weight): the k nearest of ``points`` for each of ``queries``.

    ``queries`` have distinct ``qid``; ``points`` have distinct ``pid`` and a ``weight``, the number
    of rows a point stands for. With ``exclude_self`` a query does not count itself once.
    """
    # a few numbers per cell
    shared = points.sparkSession.sparkContext.broadcast((cells.feature, cells.threshold, cells.left, cells.right))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Cells(*shared.value)
        for batch in batches:
            yield batch.assign(cell=tree.home(batch[FEATURES].to_numpy()))

    some = points.select("pid", *FEATURES).orderBy("pid").limit(ANCHORS).toPandas()[FEATURES].to_numpy()
    anchors = points.sparkSession.sparkContext.broadcast(some)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Cells(*shared.value)
        for batch in batches:
            x, radius = batch[FEATURES].to_numpy(), batch["radius"].to_numpy().copy()
            short = np.flatnonzero(np.isinf(radius))
            if len(anchors.value) > k:  # one of them may be the query itself
                for part in np.array_split(short, len(short) // 1000 + 1):
                    radius[part] = np.partition(_distances(x[part], anchors.value), k, axis=1)[:, k]
                batch = batch.assign(radius=radius)
            row, cell = tree.within(x, radius)
            out = batch.iloc[row].assign(cell=cell)
            yield out[out["cell"].to_numpy() != batch["home"].to_numpy()[row]].drop(columns="home")

    placed = points.select("pid", "weight", *FEATURES).mapInPandas(locate, f"pid string, weight long, {POINT}, cell long")
    point_blocks = _block_count(placed)
    blocked = placed.join(point_blocks, "cell").withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks"))).drop("blocks")

    def look(asked: DataFrame) -> DataFrame:
        """Every query meets every block of points of its cell; both sides are cut to bounded groups."""
        parts = _block_count(asked).withColumnRenamed("blocks", "parts")
        asked = asked.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts"))).drop("parts")
        asked = asked.join(point_blocks, "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        offered = blocked.join(parts, "cell").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        group = ["cell", "block", "part"]
        return asked.groupBy(*group).cogroup(offered.groupBy(*group)).applyInPandas(_search(k, exclude_self), FOUND)

    at_home = queries.select("qid", *FEATURES).mapInPandas(locate, f"qid string, {POINT}, cell long").withColumn(
        "radius", F.lit(float("inf")))
    first = workspace.written(_nearest_k(look(at_home), k), "nearest_at_home")  # read twice below
    bound = first.groupBy("qid").agg(F.sum("weight").alias("n"), F.max("distance").alias("bound"))
    ranged = at_home.drop("radius").join(bound, "qid", "left").select(
        "qid", *FEATURES, F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("inf"))).alias("radius"),
        F.col("cell").alias("home"))
    others = ranged.mapInPandas(spread, f"qid string, {POINT}, radius double, cell long")
    return _nearest_k(first.unionByName(look(others)), k)


def _block_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
