"""Packet batches and host registrations: reading, decoding, packing, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas
from ..functions.scalars import col, event_time
from ..settings import Topics
from .rows import publish
from .wire import from_wire, to_wire

EVENT = schemas.PACKET_EVENT.names
OFFSETS_PER_TRIGGER, FILES_PER_TRIGGER = 1_000_000, 1_000
ANALYZED = ["dst_ip", "dst_port", "pkt_len", "protocol"]


def read_topic(spark: SparkSession, topic: str, topics: Topics = Topics(), **options: str) -> DataFrame:
    """A Kafka topic as a stream of (key, value); offsets are kept in the query's checkpoint.

    A micro-batch takes a bounded number of messages, so a long backlog is worked off in pieces.
    """
    options.setdefault("maxOffsetsPerTrigger", str(OFFSETS_PER_TRIGGER))
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", topics.brokers)
              .option("subscribe", topic).option("startingOffsets", topics.starting_offsets)
              .option("groupIdPrefix", topics.group_id))
    return reader.options(**options).load().select("key", "value")


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """A folder of files as a stream, a bounded number of them in each micro-batch."""
    options.setdefault("maxFilesPerTrigger", str(FILES_PER_TRIGGER))
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def read_packets(spark: SparkSession, topics: Topics = Topics(), native: bool | None = None, **options: str) -> DataFrame:
    """The packets topic, decoded to one row per packet."""
    return analyzer_columns(explode_events(decode_batches(read_topic(spark, topics.packets, topics, **options), native=native)))


def read_hosts(spark: SparkSession, topics: Topics = Topics(), native: bool | None = None, **options: str) -> DataFrame:
    return decode_hosts(read_topic(spark, topics.hosts, topics, **options), native=native)


def _decode(df: DataFrame, value: Column | str, name: str, schema: T.StructType, native: bool | None) -> DataFrame:
    decoded = df.select(from_wire(col(value), name, schema, native).alias("m"))
    counted = decoded.observe(f"{name}_messages", F.count(F.lit(1)).alias("read"), F.count_if(F.col("m").isNull()).alias("broken"))
    return counted.where(F.col("m").isNotNull()).select("m.*")


def decode_batches(df: DataFrame, value: Column | str = "value", native: bool | None = None) -> DataFrame:
    """Message bytes to packet batches; broken messages are skipped and counted in an observation."""
    return _decode(df, value, "PacketBatch", schemas.PACKET_BATCH, native)


def decode_hosts(df: DataFrame, value: Column | str = "value", native: bool | None = None) -> DataFrame:
    return _decode(df, value, "HostInfo", schemas.HOST_INFO, native)


def drop_empty_batches(batches: DataFrame) -> DataFrame:
    return batches.where(F.size("events") > 0)


def explode_events(batches: DataFrame) -> DataFrame:
    """One row per packet, with the host of its batch."""
    return batches.select("host_id", F.inline("events"))


def analyzer_columns(events: DataFrame) -> DataFrame:
    """The six columns that profiles are made of."""
    return events.select("host_id", event_time("timestamp_ns").alias("ts"), *ANALYZED)


def pack_batches(events: DataFrame, size: int = 256, flush_sec: int = 1) -> DataFrame:
    """Packets back to batches of at most ``size``, each within one ``flush_sec`` tick of a host.

    ``batch_ts`` is the time of the last packet in the batch. Work is grouped by host and tick, so
    a busy host spreads over as many groups as it has ticks.
    """
    order = Window.partitionBy("host_id", "tick").orderBy(*EVENT)
    numbered = events.select("host_id", *EVENT).withColumn("tick", _tick(flush_sec)).withColumn(
        "part", F.floor((F.row_number().over(order) - 1) / size))
    packed = numbered.groupBy("host_id", "tick", "part").agg(
        F.max("timestamp_ns").alias("batch_ts"),
        F.array_sort(F.collect_list(F.struct(*EVENT))).alias("events"))
    return packed.select("host_id", "batch_ts", "events")


def _tick(flush_sec: int) -> Column:
    ns = F.col("timestamp_ns")
    return ns - F.pmod(ns, F.lit(flush_sec * 1_000_000_000))


def encode_batches(batches: DataFrame, native: bool | None = None) -> DataFrame:
    """Non-empty batches as (key, value) messages keyed by host."""
    full = drop_empty_batches(batches)
    return full.select(F.col("host_id").alias("key"), to_wire(F.struct(*schemas.PACKET_BATCH.names), "PacketBatch", native).alias("value"))


def encode_hosts(hosts: DataFrame, native: bool | None = None) -> DataFrame:
    return hosts.select(F.col("host_id").alias("key"), to_wire(F.struct(*schemas.HOST_INFO.names), "HostInfo", native).alias("value"))


def publish_batches(batches: DataFrame, topics: Topics = Topics(), native: bool | None = None) -> None:
    """Write batches to the packets topic, those of a host in order of their time.

    A host's batches go through one task, so that they reach their partition of the topic in order.
    """
    placed = batches.repartition("host_id").sortWithinPartitions("host_id", "batch_ts")
    publish(encode_batches(placed, native), topics.packets, topics)
