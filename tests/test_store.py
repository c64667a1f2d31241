import os
from datetime import datetime, timedelta

from helpers import profile, when
from pyspark.sql import functions as F

from packetlens import schemas
from packetlens.plans import jobs, store, workspace

DAY = 86400


def table(spark, *changes):
    out = None
    for c in changes:
        row = profile(spark, **c)
        out = row if out is None else out.unionByName(row)
    return out


def test_newest_version_wins(spark):
    rows = profile(spark).select("*", F.explode(F.array(*[F.lit(v) for v in (1, 3, 2)])).alias("version"))
    found = store.latest(rows.withColumn("packets", F.col("packets") + F.col("version")), schemas.PROFILE_KEY).collect()
    assert [(r.version, r.packets) for r in found] == [(3, 13)]


def test_equal_versions_are_settled_by_batch(spark):
    rows = profile(spark).select("*", F.lit(1).alias("version"), F.explode(F.array(F.lit(5), F.lit(6))).alias("batch_id"))
    assert [r.batch_id for r in store.latest(rows, schemas.PROFILE_KEY).collect()] == [6]


def test_copies_of_a_key_are_dropped_before_the_shuffle(spark):
    rows = profile(spark).select("*", F.lit(1).alias("version"))
    plan = store.latest(rows, schemas.PROFILE_KEY)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_retention_edge(spark):
    as_of = datetime(2024, 3, 1, 12)
    rows = table(spark, *[{"window_start": as_of - timedelta(days=d)} for d in (29, 30, 31)])
    kept = store.retain(rows, F.lit(as_of), 30, "window_start").collect()
    assert [r.window_start for r in kept] == [as_of - timedelta(days=29)]


def test_load_history_and_expire(spark):
    path = workspace.fresh(spark, "test_table")
    as_of = datetime(2024, 3, 1, 12)
    rows = table(spark, *[{"window_start": as_of - timedelta(days=d)} for d in (0, 29, 30, 30.2, 29.8, 31, 40)])
    store.load_profiles(rows, path, 0)
    store.load_profiles(rows.withColumn("packets", F.lit(99).cast("long")), path, 1)
    assert spark.read.parquet(path).count() == 14
    recent = store.profile_history(spark, path, F.lit(as_of), 24)
    assert [(r.window_start, r.packets) for r in recent.collect()] == [(as_of, 99)]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    removed = store.expire(spark, path, as_of, 30, "window_start", schemas.PROFILE_KEY)
    assert sorted(removed) == ["day=2024-01-21", "day=2024-01-30"]
    left = {r.window_start for r in spark.read.parquet(path).collect()}
    assert left == {as_of - timedelta(days=d) for d in (0, 29, 29.8)}
    assert store.expire(spark, path, as_of, 30, "window_start", schemas.PROFILE_KEY) == []
    assert spark.read.parquet(path).count() == 6


def test_expire_keeps_what_is_appended_meanwhile(spark, monkeypatch):
    """A batch that is loaded while the day is rewritten stays whole until the next run."""
    path = workspace.fresh(spark, "test_table")
    as_of = datetime(2024, 3, 1, 12)
    rows = table(spark, *[{"window_start": as_of - timedelta(days=d)} for d in (0, 29.8, 30.2)])
    store.load_profiles(rows, path, 0)
    retain = store.retain

    def appended(*args):
        kept = retain(*args)
        store.load_profiles(rows.withColumn("packets", F.lit(77).cast("long")), path, 1)
        return kept

    monkeypatch.setattr(store, "retain", appended)
    store.expire(spark, path, as_of, 30, "window_start", schemas.PROFILE_KEY)
    monkeypatch.undo()
    found = sorted((r.batch_id, (as_of - r.window_start).total_seconds() / DAY, r.packets) for r in spark.read.parquet(path).collect())
    assert [(b, round(d, 1), p) for b, d, p in found] == [(0, 0.0, 10), (0, 29.8, 10), (1, 0.0, 77), (1, 29.8, 77), (1, 30.2, 77)]
    store.expire(spark, path, as_of, 30, "window_start", schemas.PROFILE_KEY)
    left = sorted((r.batch_id, round((as_of - r.window_start).total_seconds() / DAY, 1)) for r in spark.read.parquet(path).collect())
    assert left == [(0, 0.0), (0, 29.8), (1, 0.0), (1, 29.8)]


def test_second_pass(spark):
    path = workspace.fresh(spark, "test_table")
    as_of = when(10 * DAY)
    rows = table(spark, *[
        {"window_start": when(9.5 * DAY + 60 * i), "window_end": when(9.5 * DAY + 60 * i + 60), "pps": v}
        for i, v in enumerate([1.0, 2.0, 4.0])])
    store.load_profiles(rows, path)
    found = jobs.second_pass(spark, path, "zscore", 24, F.lit(as_of)).collect()
    assert [(r.detector, r.risk_score) for r in found] == [("ml:zscore", 0.875)]
    assert jobs.second_pass(spark, path, "zscore", 1, F.lit(as_of)).isEmpty()
    assert jobs.second_pass(spark, path, "kmeans", 24, F.lit(as_of)).isEmpty()  # no model saved


def test_workspace_follows_the_session(spark):
    root = workspace.root(spark)
    assert root == f"{spark.conf.get('spark.checkpoint.dir')}/packetlens-{spark.sparkContext.applicationId}"
    workspace.written(spark.range(3), "rows")
    assert os.path.isdir(root)
    workspace.remove(spark, root)  # what the end of the application does
    assert not os.path.exists(root)
