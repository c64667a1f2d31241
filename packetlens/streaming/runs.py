"""Starting streaming queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans import workspace

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stream_settings(spark: SparkSession, state_partitions: int | None = None) -> Iterator[None]:
    """State on disk (RocksDB) and UTC, as all streaming queries here expect, while a query starts.

    A query keeps the settings it starts with, so those of the session are put back afterwards.
    ``state_partitions``: state stores of each stateful operator, by default the session's shuffle partitions.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.session.timeZone": "UTC"}
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_new(spark: SparkSession, folder: str, schema: T.StructType, names: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)


def to_table(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, every: str = "10 seconds", state_partitions: int | None = None,
) -> StreamingQuery:
    """Append a stream to a Parquet table; the checkpoint and the sink's log make each row land once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with stream_settings(stream.sparkSession, state_partitions):
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def run_available(stream: DataFrame, name: str, state_partitions: int | None = None) -> DataFrame:
    """Process all that is available, then return the output as a table."""
    spark = stream.sparkSession
    path = workspace.fresh(spark, name)
    to_table(stream, path, f"{path}.checkpoint", available_now=True, state_partitions=state_partitions).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
