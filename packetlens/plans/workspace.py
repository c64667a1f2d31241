"""Where jobs keep checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: set[str] = set()


def root(spark: SparkSession) -> str:
    """This application's part of the shared folder that the session names; it goes when the application ends.

    Only local mode without a setting takes a temporary folder.
    """
    named = spark.conf.get(SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="packetlens-")
        spark.conf.set(SETTING, named)
    own = f"{named.rstrip('/')}/packetlens-{spark.sparkContext.applicationId}"
    if own not in (spark.sparkContext.getCheckpointDir() or ""):
        spark.sparkContext.setCheckpointDir(own)
    if own not in _own:
        _own.add(own)
        atexit.register(remove, spark, own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store; one that is gone, or out of reach by now, is left alone."""
    with contextlib.suppress(Exception):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _own.discard(path)


def fresh(spark: SparkSession, name: str) -> str:
    """A path that no earlier run has used."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Materialize as a table in the shared folder: the lineage ends there and survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
