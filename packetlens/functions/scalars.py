"""Column helpers shared by detectors, sinks and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_time(ts_ns: Column | str) -> Column:
    """Nanoseconds since the epoch as a timestamp (µs precision, truncated)."""
    return F.timestamp_micros(_div(col(ts_ns), 1000))


def _div(x: Column, by: int) -> Column:
    """Integer division that truncates towards zero, exact for 64-bit integers."""
    return F.call_function("div", x, F.lit(by))


def alert_id(host_id: Column | str, window_start: Column | str, detector: Column | str) -> Column:
    """SHA-1 of ``host|whole seconds of window start|detector``: the same alert always has the same id."""
    seconds = _div(F.unix_micros(col(window_start)), 1_000_000).cast("string")
    return F.sha1(F.concat_ws("|", col(host_id), seconds, col(detector)).cast("binary"))


def timestamp_text(ts: Column | str) -> Column:
    """UTC text with microseconds (the session time zone must be UTC)."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def to_millis(ts: Column | str) -> Column:
    return F.date_trunc("MILLISECOND", col(ts))


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_label(severity: Column | str) -> Column:
    """1..4 to low..critical; anything else is NULL."""
    return _lookup(schemas.SEVERITIES, col(severity).cast("int"))


def severity_code(label: Column | str) -> Column:
    return _lookup({v: k for k, v in schemas.SEVERITIES.items()}, F.lower(col(label)))


def window_type_name(code: Column | str) -> Column:
    """1, 2, 3 to the name; any other number counts as tumbling."""
    return F.coalesce(_lookup(schemas.WINDOW_TYPES, col(code).cast("int")), F.lit("tumbling"))


def window_type_code(name: Column | str) -> Column:
    """Name to 1, 2, 3; an unknown name is NULL."""
    return _lookup({v: k for k, v in schemas.WINDOW_TYPES.items()}, col(name))


def hook_name(code: Column | str) -> Column:
    return _lookup(schemas.HOOK_NAMES, col(code).cast("int"))


def direction_name(code: Column | str) -> Column:
    return _lookup(schemas.DIRECTION_NAMES, col(code).cast("int"))


def insert_version(at: Column | None = None) -> Column:
    """Milliseconds of insertion; the highest version of a key wins."""
    return F.unix_millis(F.current_timestamp() if at is None else at)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def feature_vector() -> Column:
    """The 11 features as an array of doubles, in their fixed order."""
    return F.array(*[F.col(name).cast("double") for name in schemas.FEATURES])


def feature_map() -> Column:
    return F.map_from_arrays(F.array(*[F.lit(name) for name in schemas.FEATURES]), feature_vector())


def feature_struct() -> Column:
    return F.struct(*[F.col(name).cast("double").alias(name) for name in schemas.FEATURES])
