"""Registered queries over the driver's tables.

Timestamps leave a query as whole microseconds and computed doubles are rounded to 6 places, so
that results can be compared between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import schemas
from .functions import scalars
from .operators import alerts as A
from .operators import windows as W
from .operators.filters import capture_scope, late_events, recent
from .operators.rules import rule_alerts
from .operators.zscore import zscore_alerts
from .operators import registry
from .plans import jobs, store, workspace
from .settings import AnalyzerSettings
from .sources import frames, packets, rows
from .streaming import hosts, live, runs, sessions
from .testpackets import (
    THRESHOLDS, WINDOWS, capture_events, frames_from, hosts_from, load_events, load_packets, packets_from, records_from,
)

OFF_TIE = 1.23e-7
STATE_PARTITIONS = 4  # state stores per operator of the registered streams
Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as whole microseconds (``<name>_us``), doubles rounded to 6 places.

    Statistics of gaps in whole microseconds often end in exactly half a microsecond, where engines
    round either way; they are moved off that point by ``OFF_TIE`` first, here and in the SQL.
    """
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "timestamp":
            out.append(F.unix_micros(f.name).alias(f.name if f.name.endswith("_us") else f"{f.name}_us"))
        elif f.name.startswith("conn_interval"):
            out.append(F.round(F.col(f.name) + OFF_TIE, 6).alias(f.name))
        elif kind == "double":
            out.append(F.round(f.name, 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def packets_view(spark: SparkSession, sf: str) -> DataFrame:
    return plain(load_packets(spark, sf))


def _profiles(*kinds: str) -> Query:
    return lambda spark, sf: plain(W.profiles(load_packets(spark, sf), WINDOWS, kinds))


def alert_rows(df: DataFrame) -> DataFrame:
    return plain(df.drop("details"))


def _rule_alerts(*kinds: str) -> Query:
    return lambda spark, sf: alert_rows(rule_alerts(W.profiles(load_packets(spark, sf), WINDOWS, kinds), THRESHOLDS))


def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return alert_rows(zscore_alerts(W.profiles(load_packets(spark, sf), WINDOWS)))


def combined_risk(spark: SparkSession, sf: str) -> DataFrame:
    profiles = workspace.written(W.profiles(load_packets(spark, sf), WINDOWS), "profile_rows")
    found = rule_alerts(profiles, THRESHOLDS).unionByName(zscore_alerts(profiles))
    return plain(A.combined_risk(found))


# ---- messages and tables ------------------------------------------------------------------------

AS_OF = 1705752000  # 2024-01-20 12:00:00 UTC
RETAIN_AS_OF = 1707566400  # 2024-02-10 12:00:00 UTC


def _time(seconds: int):
    return F.timestamp_seconds(F.lit(seconds))


def _messages(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Every field of the messages; times as the texts they hold, details as the names in them."""
    told = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema.fields])
    found = messages.select("key", F.from_json("value", told).alias("m")).select("key", "m.*")
    if "details" in schema.names:
        names = F.map_keys(F.from_json("details", "map<string,double>"))
        found = found.withColumn("details", F.array_join(F.array_sort(names), ","))
    return plain(found)


def profiles_json(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(rows.profiles_as_json(W.profiles(load_packets(spark, sf), WINDOWS)), schemas.PROFILES)


def alerts_json(spark: SparkSession, sf: str) -> DataFrame:
    found = rule_alerts(W.profiles(load_packets(spark, sf), WINDOWS), THRESHOLDS)
    return _messages(rows.alerts_as_json(found), schemas.ALERT_ROWS)


def _with_broken(messages: DataFrame, spark: SparkSession, sf: str, renames: dict[str, str]) -> DataFrame:
    """The messages, one broken text for each event, and one copy of each message with unknown codes."""
    broken = load_events(spark, sf).select(F.concat(F.lit("not json "), F.col("event_id")).alias("value"))
    unknown = F.col("value")
    for old, new in renames.items():
        unknown = F.replace(unknown, F.lit(old), F.lit(new))
    return messages.select("value").unionByName(broken).unionByName(messages.select(unknown.alias("value")))


def _profile_messages(spark: SparkSession, sf: str) -> DataFrame:
    messages = rows.profiles_as_json(W.tumbling_profiles(load_packets(spark, sf), WINDOWS))
    return _with_broken(messages, spark, sf, {"tumbling": "hourly"})


def profiles_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return plain(rows.parse_rows(_profile_messages(spark, sf), schemas.PROFILES)[0])


def profiles_quarantined(spark: SparkSession, sf: str) -> DataFrame:
    bad = rows.parse_rows(_profile_messages(spark, sf), schemas.PROFILES)[1]
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("messages"))


def alerts_loaded(spark: SparkSession, sf: str) -> DataFrame:
    messages = rows.alerts_as_json(rule_alerts(W.profiles(load_packets(spark, sf), WINDOWS), THRESHOLDS))
    unknown = {f'"severity":{code}': '"severity":9' for code in schemas.SEVERITIES}
    good = rows.parse_rows(_with_broken(messages, spark, sf, unknown), schemas.ALERT_ROWS)[0]
    return plain(good.drop("details"))


def alert_tables_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Alert messages from text files through the loading job into the stored table."""
    base = workspace.fresh(spark, "alert_tables")
    messages = rows.alerts_as_json(rule_alerts(W.profiles(load_packets(spark, sf), WINDOWS), THRESHOLDS))
    unknown = {f'"severity":{code}': '"severity":9' for code in schemas.SEVERITIES}
    _with_broken(messages, spark, sf, unknown).write.text(f"{base}/messages")
    live.load_tables(spark.readStream.text(f"{base}/messages"), schemas.ALERT_ROWS, f"{base}/alerts", store.ALERT_TS, schemas.ALERT_KEY,
                     f"{base}/checkpoint", f"{base}/quarantine", available_now=True).awaitTermination()
    return plain(spark.read.parquet(f"{base}/alerts").select(*schemas.ALERT_ROWS.names).drop("details"))


def feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The features of every profile by place and by name, and window types by code, also for codes that are none."""
    profiles = W.profiles(load_packets(spark, sf), WINDOWS)
    code = scalars.window_type_code("window_type")
    keyed = profiles.select(
        "host_id", "window_type", "window_start", scalars.window_type_name(code).alias("named"),
        scalars.window_type_name(code + 7).alias("unnamed"), scalars.feature_vector().alias("v"), scalars.feature_map().alias("m"))
    out = keyed.select("host_id", "window_type", "window_start", "named", "unnamed", "v", F.explode("m").alias("feature", "number"))
    shift = F.when(F.col("feature").startswith("conn_interval"), OFF_TIE).otherwise(0.0)
    place = F.array_position(F.array(*[F.lit(f) for f in schemas.FEATURES]), F.col("feature")).cast("int")
    return plain(out.withColumn("at_place", F.element_at("v", place) + shift).withColumn("number", F.col("number") + shift).drop("v"))


def alert_details(spark: SparkSession, sf: str) -> DataFrame:
    """What the rules' JSON details say, one row per number."""
    found = rule_alerts(W.profiles(load_packets(spark, sf), WINDOWS), THRESHOLDS)
    parsed = found.select("host_id", "detector", "window_type", "window_start", "window_end",
                          F.explode(F.from_json("details", "map<string,double>")).alias("metric", "number"))
    shift = F.when(F.col("metric").startswith("conn_interval"), OFF_TIE).otherwise(0.0)
    return plain(parsed.withColumn("number", F.col("number") + shift))


def analyzer_view(spark: SparkSession, sf: str) -> DataFrame:
    """Captured events with monotonic nanoseconds as the columns that profiles are made of."""
    return plain(packets.analyzer_columns(capture_events(load_packets(spark, sf))))


def nonempty_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Packed batches among which every host has sent an empty one."""
    full = packets.pack_batches(capture_events(load_packets(spark, sf)), 16, 86400)
    none = full.select("host_id").distinct().select(
        "host_id", F.lit(0).cast("long").alias("batch_ts"), F.array().cast(full.schema["events"].dataType).alias("events"))
    kept = packets.drop_empty_batches(full.unionByName(none))
    return kept.select("host_id", F.size("events").cast("long").alias("events"), "batch_ts")


def _versions(df: DataFrame) -> DataFrame:
    """Every row three times, as versions 1, 3 and 2."""
    return df.withColumn("version", F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 3, 2)])))


def latest_profiles(spark: SparkSession, sf: str) -> DataFrame:
    table = _versions(W.profiles(load_packets(spark, sf), WINDOWS)).withColumn("packets", F.col("packets") + F.col("version"))
    return plain(store.latest(table, schemas.PROFILE_KEY).select(*schemas.PROFILE_KEY, "packets", "version"))


def latest_alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = rule_alerts(W.profiles(load_packets(spark, sf), WINDOWS), THRESHOLDS)
    table = _versions(found.withColumn("detected_at", F.col("window_start"))).withColumn(
        "version", F.col("version") * 10 + F.length("window_type"))
    return plain(store.latest(table, schemas.ALERT_KEY).select(*schemas.ALERT_KEY, "alert_id", "version"))


def recent_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return plain(recent(W.profiles(load_packets(spark, sf), WINDOWS), _time(AS_OF), 72))


def retained_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return plain(store.retain(
        W.profiles(load_packets(spark, sf), WINDOWS), _time(RETAIN_AS_OF), schemas.PROFILE_TTL_DAYS, store.PROFILE_TS))


def _stored_profiles(spark: SparkSession, sf: str) -> str:
    """A stored table with every profile loaded twice; the second load corrects the packet counts."""
    path = workspace.fresh(spark, "profiles")
    profiles = workspace.written(W.profiles(load_packets(spark, sf), WINDOWS), "profile_rows")
    for batch, extra in ((0, 0), (1, 1000)):
        rows_ = profiles.withColumn("packets", F.col("packets") + extra)
        store.load_rows(rows_, path, store.PROFILE_TS, schemas.PROFILE_KEY, batch, _time(AS_OF + batch))
    return path


def profile_history(spark: SparkSession, sf: str) -> DataFrame:
    return plain(store.profile_history(spark, _stored_profiles(spark, sf), _time(AS_OF), 72))


def clustered_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each day of the stored table, and how many of them stand before the row ahead of them in their file."""
    table = spark.read.parquet(_stored_profiles(spark, sf))
    placed = table.select("day", F.struct(*schemas.PROFILE_KEY).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    return placed.withColumn("wrong", (F.col("key") < before).cast("long")).groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("profiles"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("out_of_order"))


# ---- decoding and batches -----------------------------------------------------------------------

FRAME_FIELDS = ["host_id", "event_id", "src_ip", "dst_ip", "src_port", "dst_port", "pkt_len", "protocol"]


def batch_pack(spark: SparkSession, sf: str) -> DataFrame:
    packed = packets.pack_batches(capture_events(load_packets(spark, sf)), size=16, flush_sec=86400)
    lengths = F.transform("events", lambda e: e["pkt_len"])
    return packed.select(
        "host_id", "batch_ts", F.size("events").cast("long").alias("packets"),
        F.element_at("events", 1)["timestamp_ns"].alias("first_ns"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"))


def batch_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    packed = packets.pack_batches(capture_events(load_packets(spark, sf)), size=64, flush_sec=86400)
    return packets.explode_events(packets.decode_batches(packets.encode_batches(packed)))


def host_registrations(spark: SparkSession, sf: str) -> DataFrame:
    hosts = hosts_from(spark.read.parquet(f"{sf}/supplier.parquet"))
    decoded = packets.decode_hosts(packets.encode_hosts(hosts))
    listed = F.transform(F.array_sort(F.map_entries("interfaces")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return decoded.withColumn("interfaces", F.concat_ws(",", listed))


def _frames(link: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return frames.decode_frames(frames_from(load_packets(spark, sf), link), link=link).select(*FRAME_FIELDS)
    return run


def record_decode(spark: SparkSession, sf: str) -> DataFrame:
    return frames.decode_records(records_from(load_packets(spark, sf))).drop("record")


def wallclock(spark: SparkSession, sf: str) -> DataFrame:
    found = load_packets(spark, sf)
    hosts = found.select("host_id").distinct().withColumn(
        "offset_ns", F.substring("host_id", 2, 9).cast("long") * 1_000_000_000 + 17)
    events = capture_events(found).withColumnRenamed("timestamp_ns", "ktime_ns")
    return frames.to_wallclock(events, hosts).select("host_id", "event_id", "timestamp_ns")


def scope(spark: SparkSession, sf: str) -> DataFrame:
    events = capture_events(load_packets(spark, sf))
    parts = [
        capture_scope(events, mode, direction, interfaces).withColumn("scope", F.lit(f"{mode}/{direction}"))
        for mode, direction, interfaces in SCOPES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("scope", "host_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("pkt_len").alias("bytes"))


SCOPES = [
    ("interface", "ingress", [1, 2]), ("interface", "egress", [1, 2]), ("interface", "both", [1, 2]),
    ("cgroup", "ingress", None), ("cgroup", "egress", None), ("cgroup", "both", None),
]


def late(spark: SparkSession, sf: str) -> DataFrame:
    """Packets that arrive shuffled within blocks of a thousand."""
    eid = F.col("event_id")
    arrived = load_packets(spark, sf).withColumn("arrival", eid - eid % 1000 + (eid * 37) % 1000)
    marked = late_events(arrived, "arrival", WINDOWS.watermark_sec, chunk=400)
    return marked.select("arrival", "event_id", "watermark_us", "is_late")


# ---- streams ------------------------------------------------------------------------------------


def _packet_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = load_events(spark, sf).schema
    return packets_from(runs.read_new(spark, sf, schema, "events.parquet"))


def _merged(rows: DataFrame) -> DataFrame:
    return plain(sessions.merge_shares(rows, WINDOWS))


def _stream(*kinds: str) -> Query:
    return lambda spark, sf: _merged(runs.run_available(
        hosts.closed_rows(_packet_stream(spark, sf), WINDOWS, 4, kinds), f"stream_{'_'.join(kinds)}", STATE_PARTITIONS))


BATCHES = 8
ROW_GROUP = 4 << 20  # bytes


def _by_time(events: DataFrame) -> Column:
    """Which of eight files, of about the same size, an event is in if they come in order of time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(F.percentile_approx(us, [k / BATCHES for k in range(1, BATCHES)], 10_000)).first()[0]
    return reduce(lambda a, b: a + b, [F.coalesce(us > F.lit(cut), F.lit(False)).cast("int") for cut in cuts])


def _by_arrival(events: DataFrame) -> Column:
    """The same if events come shuffled within blocks of a thousand."""
    eid = F.col("event_id")
    arrival = eid - eid % 1000 + (eid * 37) % 1000
    top = events.agg(F.max(arrival)).first()[0]
    return F.floor(arrival * BATCHES / F.lit((top or 0) + 1))


def _in_batches(spark: SparkSession, sf: str, name: str, place: Callable[[DataFrame], Column], run: Callable[[DataFrame, str], None]) -> str:
    """Run a stream over eight files, one per micro-batch, with a restart after the fourth; the folder it worked in."""
    base, events = workspace.fresh(spark, name), load_events(spark, sf)
    placed = events.withColumn("place", place(events))
    for half in (range(BATCHES // 2), range(BATCHES // 2, BATCHES)):
        for k in half:
            # all tasks read and one writes; short row groups, so that all tasks read the micro-batch too
            placed.where(F.col("place") == k).drop("place").repartition(1).write.option("parquet.block.size", ROW_GROUP).parquet(f"{base}/events/{k}")
        stream = packets_from(spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option(
            "maxFilesPerTrigger", 1).parquet(f"{base}/events"))
        run(stream, base)
    return base


def _stream_batches(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        def append(stream: DataFrame, base: str) -> None:
            runs.to_table(hosts.closed_rows(stream, WINDOWS, 4, (kind,)), f"{base}/out", f"{base}/checkpoint", available_now=True,
                          state_partitions=STATE_PARTITIONS).awaitTermination()

        base = _in_batches(spark, sf, f"{kind}_batches", _by_time, append)
        return _merged(spark.read.schema(hosts.CLOSED).parquet(f"{base}/out"))
    return run


def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Packets that arrive out of order: every report of a tumbling or sliding window, and how many packets each host sent late."""
    kinds = ("tumbling", "sliding")

    def append(stream: DataFrame, base: str) -> None:
        def load(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        live.start(hosts.closed_rows(stream, WINDOWS, 4, kinds), load, f"{base}/checkpoint", available_now=True,
                   state_partitions=STATE_PARTITIONS).awaitTermination()

    base = _in_batches(spark, sf, "late_batches", _by_arrival, append)
    found = spark.read.schema(f"{hosts.CLOSED}, batch int").parquet(f"{base}/out")
    reports = found.where(F.col("window_type") != hosts.LATE).groupBy("host_id", "window_type", "start_us", "batch").agg(
        *[F.sum(c).alias(c) for c in ("packets", "bytes", "uniq_dst_ip", "uniq_dst_port")], F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    counted = sessions.late_counts(found).select(
        "host_id", F.lit(hosts.LATE).alias("window_type"), "packets")
    return reports.drop("batch").unionByName(counted, allowMissingColumns=True)


def _live(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Run the live job over all packets; the paths of its profile and alert tables."""
    base = workspace.fresh(spark, "live")
    sinks = live.table_sinks(f"{base}/profiles", f"{base}/alerts")
    detectors = [registry.detector("rule", thresholds=THRESHOLDS)]
    live.live(_packet_stream(spark, sf), detectors, sinks, f"{base}/checkpoint", WINDOWS, 4, available_now=True,
              state_partitions=STATE_PARTITIONS).awaitTermination()
    return f"{base}/profiles", f"{base}/alerts"


def stream_all(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(_live(spark, sf)[0])
    return plain(store.latest(table, schemas.PROFILE_KEY).select(*schemas.PROFILES.names))


def live_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(spark.read.parquet(_live(spark, sf)[1]).select(*schemas.ALERT_ROWS.names).drop("details"))


def live_all_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Rules, z-scores and a saved model in the live job, over eight micro-batches with a restart."""
    root = _model_root(spark)

    def run(stream: DataFrame, base: str) -> None:
        detectors = [registry.detector("rule", thresholds=THRESHOLDS), registry.detector("zscore"),
                     registry.detector("isoforest").load(spark, root)]
        live.live(stream, detectors, live.table_sinks(f"{base}/profiles", f"{base}/alerts"), f"{base}/checkpoint", WINDOWS, 4,
                  available_now=True, state_partitions=STATE_PARTITIONS).awaitTermination()

    base = _in_batches(spark, sf, "live_batches", _by_time, run)
    return plain(spark.read.parquet(f"{base}/alerts").select(*schemas.ALERT_ROWS.names).drop("details"))


def stream_zscore(spark: SparkSession, sf: str) -> DataFrame:
    path = workspace.fresh(spark, "profiles")
    W.profiles(load_packets(spark, sf), WINDOWS).write.parquet(path)
    found = live.stream_zscore_alerts(live.read_table(spark, path, schemas.PROFILES))
    return alert_rows(runs.run_available(found, "stream_zscore", STATE_PARTITIONS))


def tables_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Messages from text files through the loading job into the stored table."""
    base = workspace.fresh(spark, "tables")
    _profile_messages(spark, sf).write.text(f"{base}/messages")
    stream = spark.readStream.text(f"{base}/messages")
    live.load_tables(stream, schemas.PROFILES, f"{base}/profiles", store.PROFILE_TS, schemas.PROFILE_KEY,
                     f"{base}/checkpoint", f"{base}/quarantine", available_now=True).awaitTermination()
    return plain(spark.read.parquet(f"{base}/profiles").select(*schemas.PROFILES.names))


# ---- trained detectors --------------------------------------------------------------------------


def _profile_rows(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.written(W.profiles(load_packets(spark, sf), WINDOWS), "profile_rows")


def _trained(core: str, **params) -> Query:
    """Train on all profiles, save, load, and score them again."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        profiles, root = _profile_rows(spark, sf), workspace.fresh(spark, "models")
        jobs.train(profiles, core, root, **params)
        return alert_rows(registry.detector(core).load(spark, root).score(profiles))
    return run


def kmeans_given_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Distance scoring with the mean profile of each window type as the centres."""
    profiles = _profile_rows(spark, sf)
    means = profiles.groupBy("window_type").agg(*[F.avg(f).alias(f) for f in schemas.FEATURES])
    scorer = registry.detector("kmeans").with_centres(profiles, [list(r[1:]) for r in means.collect()])
    return alert_rows(scorer.score(profiles))


# models of plain arithmetic, which SQL can repeat. Forest: three trees of nodes (feature, threshold, left, right, depth)
GIVEN_FOREST = [
    [(0, 12.0, 1, 2, 0.0), (-1, 0.0, 1, 1, 1.0), (5, 8.0, 3, 4, 0.0), (-1, 0.0, 3, 3, 3.0), (-1, 0.0, 4, 4, 6.0)],
    [(6, 3.0, 1, 2, 0.0), (-1, 0.0, 1, 1, 2.0), (7, 4.0, 3, 4, 0.0), (-1, 0.0, 3, 3, 4.5), (-1, 0.0, 4, 4, 2.5)],
    [(1, 1500.0, 1, 2, 0.0), (-1, 0.0, 1, 1, 1.5), (-1, 0.0, 2, 2, 5.0)],
]
GIVEN_OFFSET = -0.85
GIVEN_SVM = {"n_features": 4, "gamma": 1e-6, "w": [0.5, -0.25, 0.75, 0.1], "offset": 0.1}
GIVEN_NETWORK = {
    "sizes": [11, 2, 11], "weights": [((7 * i) % 13 - 6) / 10 for i in range(11 * 2 + 2 + 2 * 11 + 11)],
    "mean": [float(10 * i) for i in range(11)], "scale": [float(50 * (i + 1)) for i in range(11)], "threshold": 40.0}


def _given(name: str, model: dict, **params) -> Query:
    """Save a model, load it as any saved one and score all profiles with it."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        root = workspace.fresh(spark, "models")
        maker = registry.detector(name, **params)
        maker.model = model
        maker.save(spark, root)
        return alert_rows(registry.detector(name, **params).load(spark, root).score(_profile_rows(spark, sf)))
    return run


def given_forest() -> dict:
    nodes = [node for tree in GIVEN_FOREST for node in tree]
    sizes = [len(tree) for tree in GIVEN_FOREST]
    columns = dict(zip(("feature", "threshold", "left", "right", "depth"), map(list, zip(*nodes))))
    return {**columns, "roots": [sum(sizes[:i]) for i in range(len(sizes))], "sample": 256, "offset": GIVEN_OFFSET}


def _model_root(spark: SparkSession) -> str:
    """A folder with a saved forest."""
    root = workspace.fresh(spark, "models")
    maker = registry.detector("isoforest")
    maker.model = given_forest()
    maker.save(spark, root)
    return root


def all_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """All detectors that the settings name, one of them with a saved model."""
    settings = AnalyzerSettings(detectors=("rule", "zscore", "isoforest"), model_root=_model_root(spark), thresholds=THRESHOLDS)
    return alert_rows(registry.score_all(_profile_rows(spark, sf), registry.build_detectors(spark, settings)))


def second_pass_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return alert_rows(jobs.second_pass(spark, _stored_profiles(spark, sf), "zscore", 240, _time(AS_OF)))


def second_pass_model(spark: SparkSession, sf: str) -> DataFrame:
    settings = AnalyzerSettings(model_root=_model_root(spark))
    return alert_rows(jobs.second_pass(spark, _stored_profiles(spark, sf), None, 240, _time(AS_OF), settings))


# most alerts that a core may give on the profiles it was trained on, as a share
SHARES = {"isoforest": 0.02, "kmeans": 0.01}


def training_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Trained twice on all profiles: whether alerts are one for a profile and as rare as the cutoff says, and the same again."""
    profiles, out = _profile_rows(spark, sf), []
    key = ["host_id", "window_type", "window_start"]
    for core, share in SHARES.items():
        rows_ = profiles.select(F.lit("all").alias("part"), *key, F.lit(0.0).alias("risk_score"))
        for version in ("first", "second"):
            root = workspace.fresh(spark, "models")
            jobs.train(profiles, core, root, version)
            found = registry.detector(core, model_version=version).load(spark, root).score(profiles)
            rows_ = rows_.unionByName(workspace.written(found, "trained").select(F.lit(version).alias("part"), *key, "risk_score"))
        named, mark = F.xxhash64(*key).cast("decimal(38,0)"), F.xxhash64(*key, "risk_score").cast("decimal(38,0)")

        def of(part: str, value: Column) -> Column:
            return F.when(F.col("part") == part, value)

        found = rows_.agg(
            F.count_if(F.col("part") == "all").alias("profiles"), F.count_if(F.col("part") == "first").alias("alerts"),
            F.count_distinct(of("first", named)).alias("windows"), F.sum(of("first", mark)).alias("one"), F.sum(of("second", mark)).alias("two"),
            F.min("risk_score").alias("least"), F.max("risk_score").alias("most"))
        out.append(found.select(
            F.lit(core).alias("core"), "profiles", (F.col("alerts") == F.col("windows")).alias("one_each"),
            F.col("alerts").between(1, F.ceil(F.col("profiles") * share)).alias("rare"),
            ((F.col("least") >= 0) & (F.col("most") <= 1)).alias("in_range"), F.col("one").eqNullSafe(F.col("two")).alias("same_again")))
    return reduce(DataFrame.unionByName, out)


QUERIES: dict[str, Query] = {
    "packets_view": packets_view,
    "tumbling_profiles": _profiles("tumbling"),
    "sliding_profiles": _profiles("sliding"),
    "session_profiles": _profiles("session"),
    "all_profiles": _profiles(*W.ALL_KINDS),
    "rule_alerts_tumbling": _rule_alerts("tumbling"),
    "rule_alerts_all": _rule_alerts(*W.ALL_KINDS),
    "zscore_alerts": zscore,
    "combined_risk": combined_risk,
    "profiles_json": profiles_json,
    "alerts_json": alerts_json,
    "profiles_loaded": profiles_loaded,
    "profiles_quarantined": profiles_quarantined,
    "alerts_loaded": alerts_loaded,
    "alert_tables_loaded": alert_tables_loaded,
    "alert_details": alert_details,
    "feature_columns": feature_columns,
    "analyzer_view": analyzer_view,
    "nonempty_batches": nonempty_batches,
    "latest_profiles": latest_profiles,
    "latest_alerts": latest_alerts,
    "recent_profiles": recent_profiles,
    "retained_profiles": retained_profiles,
    "profile_history": profile_history,
    "clustered_layout": clustered_layout,
    "batch_pack": batch_pack,
    "batch_roundtrip": batch_roundtrip,
    "host_registrations": host_registrations,
    "frame_decode": _frames("ethernet"),
    "ip_decode": _frames("ip"),
    "record_decode": record_decode,
    "wallclock": wallclock,
    "capture_scope": scope,
    "late_events": late,
    "stream_tumbling": _stream("tumbling"),
    "stream_sliding": _stream("sliding"),
    "stream_session": _stream("session"),
    "stream_tumbling_batches": _stream_batches("tumbling"),
    "stream_session_batches": _stream_batches("session"),
    "stream_late": stream_late,
    "stream_all": stream_all,
    "live_alerts": live_alerts,
    "live_all_alerts": live_all_alerts,
    "stream_zscore": stream_zscore,
    "tables_loaded": tables_loaded,
    "all_alerts": all_alerts,
    "second_pass_zscore": second_pass_zscore,
    "second_pass_model": second_pass_model,
    "training_invariants": training_invariants,
    "kmeans_given_centres": kmeans_given_centres,
    "isoforest_given_forest": _given("isoforest", given_forest()),
    "ocsvm_given_weights": _given("ocsvm", {k: v for k, v in GIVEN_SVM.items() if k != "n_features"}, n_features=GIVEN_SVM["n_features"]),
    "mlp_given_weights": _given("mlp", GIVEN_NETWORK),
    "kmeans_alerts": _trained("kmeans"),
    "isoforest_alerts": _trained("isoforest"),
    "lof_alerts": _trained("lof"),
    "ocsvm_alerts": _trained("ocsvm"),
    "autoencoder_alerts": _trained("mlp"),
}
