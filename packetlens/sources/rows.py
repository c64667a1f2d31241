"""JSON messages of profiles and alerts: parsing with quarantine, and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.scalars import col, severity_label, timestamp_text, to_millis, window_type_code
from ..settings import Topics

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]"
_BROKEN = "_broken"


def _typed(message: Column, schema: T.StructType) -> list[Column]:
    """Message fields with the table's types: times cut to milliseconds, absent values to 0 or ''."""
    out = []
    for f in schema.fields:
        value = message[f.name]
        if isinstance(f.dataType, T.TimestampType):
            value = to_millis(value)
        else:
            value = F.coalesce(value, F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType))
        out.append(value.alias(f.name))
    return out


def check_rows(messages: DataFrame, schema: T.StructType, value: Column | str = "value") -> DataFrame:
    """Typed columns plus ``value`` and ``error`` (NULL for a good row) for every message.

    An error is a text that is not JSON of this schema, a missing key, or an unknown window type or
    severity. No message ever fails the job.
    """
    with_broken = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "timestampFormat": TIMESTAMP_FORMAT}
    parsed = messages.select(col(value).cast("string").alias("value")).withColumn(
        "m", F.from_json("value", with_broken, options))
    m = F.col("m")
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    unusable = m["host_id"].isNull()
    for name in times:
        unusable = unusable | m[name].isNull()
    error = F.when(m.isNull() | m[_BROKEN].isNotNull(), "not a message of this schema").when(unusable, "missing key")
    if "window_type" in schema.names:
        error = error.when(window_type_code(m["window_type"]).isNull(), "unknown window type")
    if "severity" in schema.names:
        error = error.when(severity_label(m["severity"]).isNull(), "unknown severity")
    return parsed.select(*_typed(m, schema), "value", error.alias("error"))


def parse_rows(messages: DataFrame, schema: T.StructType, value: Column | str = "value") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined messages with their error)."""
    checked = check_rows(messages, schema, value)
    good = checked.where(F.col("error").isNull()).select(*schema.names)
    return good, checked.where(F.col("error").isNotNull()).select("value", "error")


def _as_json(df: DataFrame, names: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    fields = [timestamp_text(n).alias(n) if kinds[n] == "timestamp" else F.col(n) for n in names]
    return df.select(F.col("host_id").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def profiles_as_json(profiles: DataFrame) -> DataFrame:
    """Profiles as (key, value) messages keyed by host."""
    return _as_json(profiles, schemas.PROFILES.names)


def alerts_as_json(alerts: DataFrame) -> DataFrame:
    """Alerts as (key, value) messages; an alert counts as detected at the start of its window."""
    return _as_json(alerts.withColumn("detected_at", F.col("window_start")), schemas.ALERT_ROWS.names)


def publish(messages: DataFrame, topic: str, topics: Topics = Topics()) -> None:
    """Write a bounded set of (key, value) messages to a Kafka topic."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", topics.brokers).option("topic", topic)
     .option("kafka.compression.type", "snappy").option("kafka.linger.ms", "50").save())
