"""Moving rows from uneven shards to new capacities with the fewest bytes moved.

The rows of each old shard fall into blocks by a hash of their id and text. Block sizes are summed in
Spark; their number is bounded by the settings, so they fit on the driver whatever the data. A minimum-cost
flow from old shard sizes to new capacities says how many bytes go from where to where, and blocks are
chosen to carry them. The plan (old shard, block -> new shard) is joined back to the rows, and the files of shards that gain
or lose rows are written anew.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import workspace


@dataclass(frozen=True)
class Resharding:
    """Settings: ``shards`` new shards of equal capacity; each old shard is cut into ``blocks`` blocks.

    There may be ``most_old`` old shards: blocks of all of them are planned on the driver and broadcast.
    """

    shards: int = 16
    blocks: int = 1024
    most_old: int = 1024


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def old_shard(source: Column, shards: int) -> Column:
    """A layout by source, as uneven as the sources are; a null source counts as the empty one."""
    return F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts from each source to each target that use up all supply at the least total cost.

    Successive cheapest paths: each round sends as much as it can along the cheapest path of the
    residual network. Total supply must equal total demand; costs are not negative.
    """
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(demand)
    while True:
        # cheapest path from any source with supply to any target with room
        best: list[float] = [0.0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        via = [-1] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if best[i] + cost[i][j] < best[n + j]:
                        best[n + j], via[n + j], changed = best[i] + cost[i][j], i, True
                    if flow[i][j] and best[n + j] - cost[i][j] < best[i]:
                        best[i], via[i], changed = best[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        ends = [j for j in range(m) if room[j] and best[n + j] < float("inf")]
        if not ends:
            return flow
        end = min(ends, key=lambda j: best[n + j])
        path, node = [], n + end
        while node >= 0:
            path.append(node)
            node = via[node]
        path.reverse()
        steps = [(a, b - n, 1) if a < n else (b, a - n, -1) for a, b in zip(path[:-1], path[1:], strict=True)]
        amount = min([left[path[0]], room[end], *(flow[i][j] for i, j, sign in steps if sign < 0)])
        for i, j, sign in steps:
            flow[i][j] += sign * amount
        left[path[0]] -= amount
        room[end] -= amount


def plan_blocks(sizes: dict[tuple[int, int], int], rule: Resharding, cost: list[list[int]] | None = None) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block). ``cost``: of moving a byte between shards, by default 1, and 0 to stay.

    Within an old shard, blocks are dealt from the largest down, each to the target whose share of the flow has
    most left; a block stays if that is equal. So shares are met up to the size of the smallest blocks.
    """
    old = sorted({o for o, _ in sizes})
    supply = [sum(s for (o, _), s in sizes.items() if o == k) for k in old]
    total = sum(supply)
    demand = [total * (j + 1) // rule.shards - total * j // rule.shards for j in range(rule.shards)]
    cost = cost or [[int(o != j) for j in range(rule.shards)] for o in old]
    flow = min_cost_flow(supply, demand, cost)
    out = {}
    # what earlier old shards gave too much or too little of is made up by later ones
    owed = [0] * rule.shards
    for i in sorted(range(len(old)), key=lambda i: (sum(f > 0 for f in flow[i]), i)):
        targets = [j for j in range(rule.shards) if flow[i][j]]
        heap = [(-(flow[i][j] + owed[j]), j != old[i], j) for j in targets]
        heapq.heapify(heap)
        for size, block in sorted(((s, b) for (o, b), s in sizes.items() if o == old[i]), key=lambda x: (-x[0], x[1])):
            need, moves, j = heapq.heappop(heap)
            out[old[i], block] = j
            heapq.heappush(heap, (need + size, moves, j))
        for need, _, j in heap:
            owed[j] = -need
    return out


def crc_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 text; a null text counts as the empty one."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def block_of(doc_id: Column, crc: Column, rule: Resharding) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long"), crc), F.lit(rule.blocks)).cast("int")


def _short(docs: DataFrame, old: Column, rule: Resharding) -> DataFrame:
    """(doc_id, text_crc32, size, old_shard, block) of all rows, written: texts are read once for them."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), crc_of(F.col("text")).alias("text_crc32"), size_of(F.col("text").cast("string")).alias("size"),
        old.cast("int").alias("old_shard"))
    return workspace.written(rows.withColumn("block", block_of(F.col("doc_id"), F.col("text_crc32"), rule)), "reshard_rows")


def _planned(rows: DataFrame, rule: Resharding) -> DataFrame:
    """(old_shard, block, shard, first_slot) from short rows; at most most_old * blocks rows."""
    found = rows.select("old_shard").distinct().count()
    if found > rule.most_old:
        raise ValueError(f"{found} old shards, most_old is {rule.most_old}")
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    plan = plan_blocks({(r["old_shard"], r["block"]): r["size"] for r in sums}, rule)
    first, at = {}, [0] * rule.shards
    for r in sorted(sums, key=lambda r: (r["old_shard"], r["block"])):
        place = (r["old_shard"], r["block"])
        first[place] = at[plan[place]]
        at[plan[place]] += r["n"]
    schema = "old_shard int, block int, shard int, first_slot long"
    return rows.sparkSession.createDataFrame([(*k, plan[k], first[k]) for k in sorted(plan)], schema)


def reshard(docs: DataFrame, old: Column, rule: Resharding = Resharding()) -> DataFrame:
    """(doc_id, text_crc32, size, old_shard, shard, slot) for each row of ``docs`` (doc_id, text; ``old`` may read others).

    Shards get nearly equal bytes. ``slot`` counts the rows of a shard from 0 without gaps. Null and empty
    texts have size 1; null ids are a value like any other; rows alike in id and text share a block but have
    slots of their own. An empty table gives no rows; more old shards than ``most_old`` are refused.
    """
    rows = _short(docs, old, rule)
    order = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    within = F.row_number().over(order) - 1
    return rows.withColumn("within", within).join(F.broadcast(_planned(rows, rule)), ["old_shard", "block"]).select(
        "doc_id", "text_crc32", "size", "old_shard", "shard", (F.col("first_slot") + F.col("within")).alias("slot"))


def with_slots(rows: DataFrame, rule: Resharding = Resharding()) -> DataFrame:
    """``rows`` (doc_id, text_crc32, size, shard and others) with slot, gapless from 0 in each shard.

    Counted in two steps: blocks of a shard get their first slots from the numbers of rows before them, and rows
    are numbered inside their block, so no task sorts a shard.
    """
    rows = rows.withColumn("__block", block_of(F.col("doc_id"), F.col("text_crc32"), rule))
    counts = rows.groupBy("shard", "__block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "__block").orderBy("doc_id", "text_crc32", "size")) - 1
    # at most shards * blocks rows
    numbered = rows.withColumn("__within", within).join(F.broadcast(starts), ["shard", "__block"])
    return numbered.withColumn("slot", F.col("__first") + F.col("__within")).drop("__block", "__first", "__within")


def rewrite(docs: DataFrame, old: Column, path: str, rule: Resharding = Resharding()) -> DataFrame:
    """Rewrite the shard folders (``path``/shard=N) that gain or lose rows; others are not touched.

    ``docs`` holds the rows of all old shards, for example as read from ``path``; a column named shard is the place of a row
    and not one of its values. Returns (old_shard, shard, n, bytes) of the moved rows. Each row finds its place by its block, so texts are
    not shuffled. New files are complete beside the table before the first folder is replaced; a shard that loses its last
    row loses its folder.
    """
    spark = docs.sparkSession
    rows = _short(docs, old, rule)
    plan = workspace.written(_planned(rows, rule), "reshard_plan")
    moved = rows.join(F.broadcast(plan), ["old_shard", "block"]).where("old_shard <> shard").groupBy("old_shard", "shard").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"))
    moved = workspace.written(moved, "reshard_moved")
    # at most most_old + shards numbers
    touched = sorted({n for r in moved.collect() for n in (r["old_shard"], r["shard"])})
    if not touched:
        return moved
    places = plan.select(F.col("old_shard").alias("__old"), F.col("block").alias("__block"), F.col("shard").alias("__shard"))
    own = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    placed = docs.withColumn("__old", old.cast("int")).withColumn("__block", block_of(F.col("doc_id"), crc_of(F.col("text")), rule)).join(
        F.broadcast(places), ["__old", "__block"]).where(F.col("__shard").isin(touched))
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    placed.select(*own, F.col("__shard").alias("shard")).write.partitionBy("shard").parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in touched:
        here, new = hadoop.Path(f"{path}/shard={n}"), hadoop.Path(f"{staged}/shard={n}")
        files.delete(here, True)
        if files.exists(new):
            files.rename(new, here)
    files.delete(hadoop.Path(staged), True)
    return moved
