"""How detectors turn profiles into alert rows, and the combined risk of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import alert_id

HIT = "struct<detector:string,category:string,severity:int,risk_score:double,model_version:string,details:string>"


def hit(detector: str, category: str, severity: Column, risk: Column, details: Column, model_version: str = "") -> Column:
    """One detection as a struct; ``risk`` is rounded to 4 places, ``details`` becomes JSON."""
    return F.struct(
        F.lit(detector).alias("detector"), F.lit(category).alias("category"),
        severity.cast("int").alias("severity"), F.round(risk, 4).alias("risk_score"),
        F.lit(model_version).alias("model_version"), F.to_json(details).alias("details"),
    ).cast(HIT)


def graded(risk: Column, high_above: float, critical_above: float | None = None) -> Column:
    grade = F.when(risk > high_above, schemas.HIGH).otherwise(schemas.MEDIUM)
    if critical_above is None:
        return grade
    return F.when(risk > critical_above, schemas.CRITICAL).otherwise(grade)


def alerts_of(profiles: DataFrame, hits: list[Column]) -> DataFrame:
    """Alert rows from columns that hold a hit or NULL, in one pass over the profiles."""
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    rows = profiles.select("host_id", "window_start", "window_end", "window_type", F.inline(found))
    return rows.withColumn("alert_id", alert_id("host_id", "window_start", "detector")).select(*schemas.ALERTS.names)


def no_alerts(profiles: DataFrame) -> DataFrame:
    """An empty alert table (what a detector without a model yields)."""
    return alerts_of(profiles.where(F.lit(False)), [F.lit(None).cast(HIT)])


def combined_risk(alerts: DataFrame, rule_weight: float = 0.6, ml_weight: float = 0.4) -> DataFrame:
    """Weighted mean of the highest rule risk and the highest model risk of each host and window."""
    name, risk = F.col("detector"), F.col("risk_score")
    by_model = name.startswith("ml") | name.startswith("nn")
    best = alerts.groupBy("host_id", "window_type", "window_start", "window_end").agg(
        F.max(F.when(name.startswith("rule"), risk)).alias("rule_risk"),
        F.max(F.when(by_model, risk)).alias("model_risk"),
        F.count(F.lit(1)).alias("alerts"),
    )

    def weight(column: str, w: float) -> Column:
        return F.when(F.col(column).isNotNull(), F.lit(float(w))).otherwise(0.0)

    total = weight("rule_risk", rule_weight) + weight("model_risk", ml_weight)
    weighted = (F.coalesce("rule_risk", F.lit(0.0)) * F.lit(float(rule_weight))
                + F.coalesce("model_risk", F.lit(0.0)) * F.lit(float(ml_weight)))
    return best.withColumn("combined_risk", F.when(total > 0, F.round(weighted / total, 4)).otherwise(0.0))
