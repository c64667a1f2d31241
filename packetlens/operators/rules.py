"""The four rules: traffic volume, port scan, host scan, beaconing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import Thresholds
from .alerts import alerts_of, graded, hit
from .. import schemas


def _scan(detector: str, metric: str, threshold: int) -> Column:
    risk = F.least(F.lit(1.0), F.col(metric) / F.lit(threshold * 3))
    details = F.struct(F.col(metric), F.lit(threshold).alias("threshold"))
    return F.when(F.col(metric) >= threshold, hit(detector, "scan", graded(risk, 0.6), risk, details))


def rule_hits(t: Thresholds = Thresholds()) -> list[Column]:
    pps, bps = F.col("pps"), F.col("bps")
    load = F.least(F.lit(1.0), F.greatest(pps / F.lit(t.pps), bps / F.lit(t.bps)) / 3.0)
    volume = F.when(
        (pps > t.pps) | (bps > t.bps),
        hit("rule:volume", "dos", graded(load, 0.5), load,
            F.struct(pps, bps, F.lit(t.pps).alias("pps_thr"), F.lit(t.bps).alias("bps_thr"))))

    mean, std = F.col("conn_interval_avg"), F.col("conn_interval_std")
    spread = F.least(F.lit(1.0), std / F.lit(max(t.beacon_std_max, 1e-6)))
    regular = F.round(0.5 + 0.5 * (1.0 - spread), 4)
    beaconing = F.when(
        (F.col("window_type") == "session") & (F.col("packets") >= t.beacon_min_conns)
        & (mean > 0) & (std <= t.beacon_std_max),
        hit("rule:beaconing", "c2", F.when(regular > 0.8, schemas.CRITICAL).otherwise(schemas.HIGH), regular,
            F.struct(mean, std, F.col("packets").alias("connections"))))
    return [
        volume,
        _scan("rule:port_scan", "uniq_dst_port", t.uniq_dst_port_scan),
        _scan("rule:host_scan", "uniq_dst_ip", t.uniq_dst_ip_scan),
        beaconing,
    ]


def rule_alerts(profiles: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return alerts_of(profiles, rule_hits(thresholds))
