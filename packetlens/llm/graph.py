"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import workspace

EDGE_ROWS = 1 << 17  # of one task, 2 MB; rounds over no more edges than that need no shuffle


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _held(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` in as few partitions as ``rows`` need."""
    return edges.coalesce(max(1, -(-rows // EDGE_ROWS)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` is linked with, itself included.

    Alternates two star contractions: every node hangs its larger neighbours, then its smaller ones,
    on the smallest of them, until nothing changes; the number of rounds grows with the logarithm of the
    component size. Every step is a map-side minimum per node and a join, so one hub with many edges
    is pre-aggregated and its join is split by adaptive execution. Edges with a null end and
    loops are ignored; no edges give no rows. State is cut by checkpoints in the shared folder.
    Tasks, and with them files of shuffles and checkpoints, follow the edges (``EDGE_ROWS``) and not the number of shuffle partitions.
    """
    workspace.root(edges.sparkSession)
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(hi, lo).distinct().checkpoint()
    before = _state(now)
    now = _held(now, before[0])
    while before[0]:
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = now.select(F.explode(ends).alias("end")).select("end.u", "end.v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = _held(large, before[0]).distinct()  # a round makes no edges more than it had
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                          F.col("m").alias("v")))
        now = _held(_held(small, before[0]).distinct(), before[0]).checkpoint()
        after = _state(now)
        now = _held(now, after[0])
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
