"""Protobuf message shapes and their conversion to and from Spark rows.

Spark's own ``from_protobuf`` / ``to_protobuf`` do the work where the spark-protobuf package is on
the classpath; otherwise an Arrow UDF reads and writes whole columns (``codec.py``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .codec import Codec

PACKAGE = "traffic"

# ---- fixed values: field names, types and numbers of the wire format ---------------------------
ENUMS = {"HookType": schemas.HOOK_NAMES, "Direction": schemas.DIRECTION_NAMES}
MESSAGES = {
    "PacketEvent": [
        ("timestamp_ns", "uint64", 1), ("src_ip", "fixed32", 2), ("dst_ip", "fixed32", 3),
        ("src_port", "uint32", 4), ("dst_port", "uint32", 5), ("pkt_len", "uint32", 6),
        ("protocol", "uint32", 7), ("hook", "HookType", 8), ("direction", "Direction", 9),
        ("ifindex", "uint32", 10),
    ],
    "PacketBatch": [("host_id", "string", 1), ("batch_ts", "int64", 2), ("events", "repeated PacketEvent", 3)],
    "HostInfo": [
        ("host_id", "string", 1), ("hostname", "string", 2), ("os", "string", 3), ("arch", "string", 4),
        ("kernel_version", "string", 5), ("interfaces", "map uint32 string", 6),
        ("boot_time_sec", "int64", 7), ("register_ts", "int64", 8),
    ],
}
# -------------------------------------------------------------------------------------------------


def descriptor_set() -> bytes:
    """The message shapes as a serialized FileDescriptorSet (what Spark's functions take)."""
    from google.protobuf import descriptor_pb2

    files = descriptor_pb2.FileDescriptorSet()
    file = files.file.add(name="traffic.proto", package=PACKAGE, syntax="proto3")
    for name, values in ENUMS.items():
        enum = file.enum_type.add(name=name)
        for number, label in values.items():
            enum.value.add(name=label, number=number)
    for name, fields in MESSAGES.items():
        message = file.message_type.add(name=name)
        for field, kind, number in fields:
            _add_field(message, name, field, kind, number)
    return files.SerializeToString()


def _add_field(message, message_name: str, field: str, kind: str, number: int) -> None:
    added = message.field.add(name=field, number=number, label=1)
    head, _, rest = kind.partition(" ")
    if head == "map":
        entry = message.nested_type.add(name=field.capitalize() + "Entry")
        entry.options.map_entry = True
        for i, (part, part_kind) in enumerate(zip(("key", "value"), rest.split()), start=1):
            _add_field(entry, "", part, part_kind, i)
        kind, added.label = f"{message_name}.{entry.name}", 3
    elif head == "repeated":
        kind, added.label = rest, 3
    scalar = f"TYPE_{kind.upper()}"
    if scalar in added.Type.keys():
        added.type = added.Type.Value(scalar)
    else:
        added.type = added.TYPE_ENUM if kind in ENUMS else added.TYPE_MESSAGE
        added.type_name = f".{PACKAGE}.{kind}"


def message_class(name: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptor_set()).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{PACKAGE}.{name}"))


def _decoder(name: str, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, codec = to_arrow_type(schema), Codec(name, MESSAGES, ENUMS)

    @F.arrow_udf(returnType=schema)
    def decode(values: pa.Array) -> pa.Array:
        return codec.decode(values, arrow)

    return decode


def _encoder(name: str):
    codec = Codec(name, MESSAGES, ENUMS)

    @F.arrow_udf(returnType=T.BinaryType())
    def encode(rows: pa.Array) -> pa.Array:
        return codec.encode(rows)

    return encode


def has_protobuf() -> bool:
    """Whether Spark's own protobuf functions are on the classpath."""
    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.lang.Class.forName(
            "org.apache.spark.sql.protobuf.ProtobufDataToCatalyst", False, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception:
        return False
    return True


def unsigned(value: Column, name: str) -> Column:
    """A message as Spark decodes it, with its unsigned 32-bit fields as longs that are never negative.

    Spark reads them as signed integers, so words from 2^31 on come out negative.
    """
    fields = []
    for field, kind, _ in MESSAGES[name]:
        part = value[field]
        if kind in ("fixed32", "uint32"):
            part = part.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        elif kind.startswith("repeated"):
            part = F.transform(part, lambda x, inner=kind.split()[1]: unsigned(x, inner))
        elif kind.startswith("map uint32"):
            part = F.transform_keys(part, lambda k, _: k.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        fields.append(part.alias(field))
    return F.when(value.isNotNull(), F.struct(*fields))


def from_wire(value: Column, name: str, schema: T.StructType, native: bool | None = None) -> Column:
    """Message bytes as a struct; NULL where they cannot be parsed. ``native``: with Spark's functions, by default if there."""
    if has_protobuf() if native is None else native:
        from pyspark.sql.protobuf.functions import from_protobuf

        # fields that hold zero are not on the wire; without the second option they would be NULL
        options = {"mode": "PERMISSIVE", "emit.default.values": "true"}
        return unsigned(from_protobuf(value, name, options=options, binaryDescriptorSet=descriptor_set()), name).cast(schema)
    return _decoder(name, schema)(value)


def to_wire(row: Column, name: str, native: bool | None = None) -> Column:
    if has_protobuf() if native is None else native:
        from pyspark.sql.protobuf.functions import to_protobuf

        return to_protobuf(row, name, binaryDescriptorSet=descriptor_set())
    return _encoder(name)(row)
