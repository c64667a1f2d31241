"""Stored profile and alert tables: Parquet split by day, newest version per key, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions.scalars import insert_version
from ..operators.filters import recent

PROFILE_TS, ALERT_TS = "window_start", "detected_at"
_STAGED = "_staged_"


def latest(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The newest version of every key; equal versions are settled by batch and then by content.

    Spark drops all but one row per key before the shuffle, so a key with very many copies sends
    one row per task.
    """
    ties = [F.col(version).desc()]
    if "batch_id" in df.columns:
        ties.append(F.col("batch_id").desc())
    ties.append(F.xxhash64(*df.columns).desc())
    newest = Window.partitionBy(*keys).orderBy(*ties)
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def retain(df: DataFrame, as_of: Column, days: int, ts: str) -> DataFrame:
    """Rows that have not expired: a row expires once its time, in whole seconds, plus ``days`` is reached."""
    bound = as_of - F.make_dt_interval(days=F.lit(days))
    kept = df.where(F.date_trunc("SECOND", F.col(ts)) > bound)
    return kept.where(F.col("day") >= F.to_date(bound)) if "day" in df.columns else kept


def with_load_columns(rows: DataFrame, ts: str, batch_id: int = 0, loaded_at: Column | None = None) -> DataFrame:
    """Add ``version`` (milliseconds of insertion), ``batch_id`` and ``day``."""
    return rows.withColumns({
        "version": insert_version(loaded_at), "batch_id": F.lit(batch_id).cast("long"), "day": F.to_date(ts)})


def write_by_day(rows: DataFrame, path: str, ts: str, key: list[str], mode: str = "append") -> None:
    """Write rows split by ``day``, and by ``batch_id`` if there is one, and sorted by ``key`` inside each file.

    The rebalance hint lets Spark cut a large day into several files and join small ones, so a day
    that holds most of the rows is not written by one task.
    """
    if "day" not in rows.columns:
        rows = rows.withColumn("day", F.to_date(ts))
    parts = ["day", *(["batch_id"] if "batch_id" in rows.columns else [])]
    writer = rows.hint("rebalance", F.col("day")).sortWithinPartitions(*parts, *key).write.partitionBy(*parts)
    writer.option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def load_rows(rows: DataFrame, path: str, ts: str, key: list[str], batch_id: int = 0, loaded_at: Column | None = None) -> None:
    """Put a batch of rows into a table. A repeated batch replaces its own folders and no others."""
    write_by_day(with_load_columns(rows, ts, batch_id, loaded_at), path, ts, key, "overwrite")


def next_batch(spark: SparkSession, path: str) -> int:
    """A number that no load of the table has had, for a job that runs again and again."""
    try:
        top = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    except AnalysisException:  # no table yet
        top = None
    return 0 if top is None else top + 1


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alerts with the columns of the stored table; detected at the start of their window."""
    return alerts.withColumn("detected_at", F.col("window_start")).select(*schemas.ALERT_ROWS.names)


def load_profiles(rows: DataFrame, path: str, batch_id: int = 0) -> None:
    load_rows(rows, path, PROFILE_TS, schemas.PROFILE_KEY, batch_id)


def load_alerts(rows: DataFrame, path: str, batch_id: int = 0) -> None:
    load_rows(rows, path, ALERT_TS, schemas.ALERT_KEY, batch_id)


def profile_history(spark: SparkSession, path: str, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """Newest versions of the profiles of the last ``hours``.

    The time bound is put on the scan: all versions of a key share its window start and day, so
    filtering first cannot change which version wins.
    """
    table = recent(spark.read.parquet(path), F.current_timestamp() if as_of is None else as_of, hours)
    return latest(table, schemas.PROFILE_KEY).select(*schemas.PROFILES.names)


def expire(spark: SparkSession, path: str, as_of: datetime, days: int, ts: str, key: list[str]) -> list[str]:
    """Retention on disk: remove expired day folders and rewrite the day the limit falls in.

    Only file names are handled on the driver. The files of that day are listed first; what is kept of exactly these files
    is complete under a hidden name, with the list beside it, before any of them goes. Files that are appended meanwhile
    stay, and a run that was cut short is finished by the next one. Returns the folders that were removed.
    """
    limit = as_of - timedelta(days=days)
    file_system = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = file_system.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(name: str):
        return file_system.Path(f"{path}/{name}")

    def files(name: str) -> list[str]:
        """Data files under a folder, by their path inside it."""
        found, rows = fs.listFiles(at(name), True), []
        base = fs.makeQualified(at(name)).toString()
        while found.hasNext():
            place = found.next().getPath().toString().removeprefix(base).lstrip("/")
            if place.endswith(".parquet") and not any(part.startswith(("_", ".")) for part in place.split("/")):
                rows.append(place)
        return sorted(rows)

    def swap(staged: str) -> None:
        day = staged.removeprefix(_STAGED)
        for row in spark.read.text(f"{path}/{staged}/_old").collect():  # file names of one day
            fs.delete(at(f"{day}/{row[0]}"), False)
        for name in files(f"{staged}/_new"):
            fs.mkdirs(at(f"{day}/{name}").getParent())
            fs.rename(at(f"{staged}/_new/{name}"), at(f"{day}/{name}"))
        fs.delete(at(staged), True)

    def names() -> list[str]:
        return [status.getPath().getName() for status in fs.listStatus(folder)]

    for name in names():
        if name.startswith(_STAGED):
            if fs.exists(at(f"{name}/_old/_SUCCESS")):
                swap(name)
            else:
                fs.delete(at(name), True)
    edge = f"day={limit:%Y-%m-%d}"
    removed = [name for name in names() if name.startswith("day=") and name < edge]
    for name in removed:
        fs.delete(at(name), True)
    old = files(edge) if fs.exists(at(edge)) else []
    if old:
        table = spark.read.option("basePath", f"{path}/{edge}").parquet(*[f"{path}/{edge}/{name}" for name in old])
        kept = retain(table, F.lit(as_of), days, ts)
        parts = [c for c in kept.columns if c == "batch_id"]
        staged = f"{_STAGED}{edge}"
        kept.sortWithinPartitions(*parts, *key).write.partitionBy(*parts).mode("overwrite").parquet(f"{path}/{staged}/_new")
        spark.createDataFrame([(name,) for name in old], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{staged}/_old")
        swap(staged)
    return removed
