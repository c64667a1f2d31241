"""Batch jobs: training and the second pass over stored profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.detector import Detector
from ..operators.registry import DETECTORS, detector
from ..settings import AnalyzerSettings
from . import store


def train(profiles: DataFrame, core: str, root: str, version: str = "v1", **params) -> Detector:
    """Fit one detector on profiles and save it under ``root``."""
    fitted = detector(core, model_version=version, **params).fit(profiles)
    if fitted.model is not None:
        fitted.save(profiles.sparkSession, root)
    return fitted


def second_pass(
    spark: SparkSession, profiles_path: str, core: str | None = None, hours: int = 24, as_of: Column | None = None,
    settings: AnalyzerSettings = AnalyzerSettings(), **params,
) -> DataFrame:
    """Alerts of one detector over the newest versions of the stored profiles of the last ``hours``."""
    core = core or settings.ml_core
    scorer = detector(core, **params)
    if DETECTORS[core].needs_model:
        scorer.model_version = settings.model_version
        scorer.load(spark, settings.model_root)
    return scorer.score(store.profile_history(spark, profiles_path, as_of, hours))
