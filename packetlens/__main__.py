"""Command line: ``python -m packetlens train|second-pass|live|load-tables ...``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from . import schemas
from .operators import registry
from .plans import jobs, store
from .settings import AnalyzerSettings
from .sources import packets, rows
from .streaming import live


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="packetlens")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("second-pass", "train", "live", "load-tables"):
        command = commands.add_parser(name)
        command.add_argument("--profiles", required=True, help="profile table")
        if name != "load-tables":
            command.add_argument("--models", default=AnalyzerSettings.model_root)
            command.add_argument("--version", default=AnalyzerSettings.model_version)
        if name in ("second-pass", "train"):
            command.add_argument("--core", default=AnalyzerSettings.ml_core)
            command.add_argument("--hours", type=int, default=24)
        if name == "second-pass":
            command.add_argument("--publish", action="store_true", help="also send alerts to their topic")
        if name != "train":
            command.add_argument("--alerts", required=True, help="alert table")
        if name in ("live", "load-tables"):
            command.add_argument("--checkpoint", required=True, help="folder for the state of the queries")
        if name == "live":
            command.add_argument("--detectors", default=",".join(AnalyzerSettings.detectors))
            command.add_argument("--to-topics", action="store_true", help="send results to topics instead of tables")
    return out


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName(f"packetlens {args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = AnalyzerSettings()
    if args.command != "load-tables":
        settings = replace(settings, model_root=args.models, model_version=args.version)
    if args.command == "train":
        jobs.train(store.profile_history(spark, args.profiles, hours=args.hours), args.core, args.models, args.version)
    elif args.command == "second-pass":
        found = jobs.second_pass(spark, args.profiles, args.core, args.hours, settings=settings).persist()
        store.load_alerts(store.alert_rows(found), args.alerts, store.next_batch(spark, args.alerts))
        if args.publish:
            rows.publish(rows.alerts_as_json(found), settings.topics.alerts, settings.topics)
    elif args.command == "live":
        settings = replace(settings, detectors=tuple(n for n in args.detectors.split(",") if n != "zscore"))
        sinks = live.topic_sinks(settings.topics) if args.to_topics else live.table_sinks(args.profiles, args.alerts)
        live.live(packets.read_packets(spark, settings.topics), registry.build_detectors(spark, settings), sinks,
                  f"{args.checkpoint}/live", settings.windows)
        if "zscore" in args.detectors.split(",") and not args.to_topics:  # has state of its own, over the profile table
            live.live_zscores(spark, args.profiles, live.table_sinks(args.profiles, f"{args.alerts}_zscore")[1], f"{args.checkpoint}/zscore")
        spark.streams.awaitAnyTermination()
    else:
        for topic, schema, path, ts, key in (
                (settings.topics.profiles, schemas.PROFILES, args.profiles, store.PROFILE_TS, schemas.PROFILE_KEY),
                (settings.topics.alerts, schemas.ALERT_ROWS, args.alerts, store.ALERT_TS, schemas.ALERT_KEY)):
            live.load_tables(packets.read_topic(spark, topic, settings.topics), schema, path, ts, key,
                             f"{args.checkpoint}/{topic}", f"{path}_rejected")
        spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
