"""What all detectors share: fit on profiles, score profiles, save and load."""

from __future__ import annotations

import json
import logging
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.quantiles import exact_quantile
from ..plans import workspace
from .alerts import alerts_of, no_alerts

logger = logging.getLogger(__name__)

KEY = ["host_id", "window_type", "window_start", "window_end"]


def features(profiles: DataFrame) -> DataFrame:
    """The profile key and the 11 features as doubles."""
    return profiles.select(*KEY, *[F.col(name).cast("double").alias(name) for name in schemas.FEATURES])


class Detector:
    """Scores profiles. A detector without a model yields no alerts."""

    name = "base"
    needs_model = True
    adds_columns = True  # scoring is a set of columns on the profiles, so detectors can share a pass

    def __init__(self, model_version: str = "v1") -> None:
        self.model_version = model_version
        self.model: dict[str, Any] | None = None  # small, plain values
        self.tables: dict[str, DataFrame] = {}  # parts of a model that are tables

    def fit(self, profiles: DataFrame) -> Detector:
        """Train; an empty table leaves the detector without a model."""
        rows = workspace.written(features(profiles), f"{self.name}_training")
        if not rows.isEmpty():
            self._fit(rows)
        return self

    def score(self, profiles: DataFrame) -> DataFrame:
        if not self.active:
            return no_alerts(profiles)
        return alerts_of(self._scored(profiles), self._hits())

    def _fit(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def _quantile(self, scored: DataFrame, column: str, q: float) -> float:
        """Exact quantile of a score column, which is computed once and kept as a table."""
        return exact_quantile(workspace.written(scored.select(column), f"{self.name}_scores"), column, q)

    def _scored(self, profiles: DataFrame) -> DataFrame:
        """Profiles with the score columns that ``_hit`` reads."""
        raise NotImplementedError

    def _hit(self) -> Column:
        raise NotImplementedError

    def _hits(self) -> list[Column]:
        return [self._hit()]

    @property
    def active(self) -> bool:
        return self.model is not None or not self.needs_model

    def save(self, spark: SparkSession, root: str) -> str:
        """Write the model under ``root/<detector>/<version>``."""
        path = f"{root}/{self.name}/{self.model_version}"
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        content = spark.createDataFrame([(json.dumps(self.model),)], "model string")
        content.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return path

    def load(self, spark: SparkSession, root: str) -> Detector:
        """Read a saved model; a missing or unreadable one is logged and leaves the detector inactive."""
        path = f"{root}/{self.name}/{self.model_version}"
        try:
            model = json.loads(spark.read.parquet(f"{path}/model").first()[0])
            self.tables = {name: spark.read.parquet(f"{path}/{name}") for name in model.get("tables", [])}
            self.model = model
        except Exception:
            logger.warning("no usable model of %s under %s", self.name, path, exc_info=True)
            self.model, self.tables = None, {}
        return self
