"""Detectors by name, and scoring with several of them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession

from ..settings import AnalyzerSettings, Thresholds
from .alerts import alerts_of, no_alerts
from .autoencoder import Autoencoder
from .detector import Detector
from .isoforest import IsoForest
from .kmeans import KMeansDistance
from .lof import Lof
from .ocsvm import OneClassSvm
from .rules import rule_hits
from .zscore import zscore_hits, zscores
from ..plans import workspace

logger = logging.getLogger(__name__)


class Rules(Detector):
    name = "rule"
    needs_model = False

    def __init__(self, thresholds: Thresholds = Thresholds(), model_version: str = "") -> None:
        super().__init__(model_version)
        self.thresholds = thresholds

    def fit(self, profiles: DataFrame) -> Detector:
        return self

    def _scored(self, profiles: DataFrame) -> DataFrame:
        return profiles

    def _hits(self) -> list[Column]:
        return rule_hits(self.thresholds)


class ZScore(Detector):
    name = "zscore"
    needs_model = False
    adds_columns = False

    def __init__(self, z_threshold: float = 4.0, alpha: float = 0.2, model_version: str = "") -> None:
        super().__init__(model_version)
        self.z_threshold, self.alpha = z_threshold, alpha

    def fit(self, profiles: DataFrame) -> Detector:
        return self

    def _scored(self, profiles: DataFrame) -> DataFrame:
        return zscores(profiles, self.alpha, self.z_threshold)

    def _hits(self) -> list[Column]:
        return [zscore_hits(self.z_threshold)]


DETECTORS: dict[str, type[Detector]] = {
    d.name: d for d in (Rules, ZScore, IsoForest, Lof, OneClassSvm, KMeansDistance, Autoencoder)}


def detector(name: str, **params) -> Detector:
    """A new detector; a name that is not registered raises ValueError."""
    if name not in DETECTORS:
        raise ValueError(f"unknown detector: {name!r}")
    return DETECTORS[name](**params)


def build_detectors(spark: SparkSession, settings: AnalyzerSettings = AnalyzerSettings()) -> list[Detector]:
    """The detectors named in the settings, with their saved models where there are any."""
    out = []
    for name in settings.detectors:
        if name == "rule":
            out.append(detector(name, thresholds=settings.thresholds))
        elif not DETECTORS.get(name, Detector).needs_model:
            out.append(detector(name))
        else:
            out.append(detector(name, model_version=settings.model_version).load(spark, settings.model_root))
    return out


def score_all(profiles: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    """Alerts of all detectors.

    Detectors whose score is a set of columns share one pass over the profiles. A detector that
    cannot be set up is logged and left out; see ``score_each`` for failures while a job runs.
    ``profiles`` should be a stored table: every detector outside the shared pass reads it again.
    """
    shared, hits, parts = profiles, [], []
    for d in detectors:
        try:
            if not d.active:
                continue
            if d.adds_columns:
                shared, hits = d._scored(shared), hits + d._hits()
            else:
                parts.append(d.score(profiles))
        except Exception:  # one detector must not stop the others
            logger.exception("detector %s failed", d.name)
    if hits:
        parts.insert(0, alerts_of(shared, hits))
    out = parts[0] if parts else no_alerts(profiles)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_safely(profiles: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    """Alerts of all detectors as a written table; one that fails while it runs is logged and left out.

    All are run in one pass; only if that fails are they run one by one.
    """
    detectors = list(detectors)
    try:
        return workspace.written(score_all(profiles, detectors), "alerts")
    except Exception:
        logger.exception("detectors failed together, running each alone")
    parts = []
    score_each(profiles, detectors, lambda found: parts.append(workspace.written(found, "alerts")))
    out = parts[0] if parts else no_alerts(profiles)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_each(profiles: DataFrame, detectors: Iterable[Detector], sink: Callable[[DataFrame], None]) -> list[str]:
    """Run one job per detector and hand its alerts to ``sink``; returns the names of those that failed."""
    failed = []
    for d in detectors:
        try:
            sink(d.score(profiles))
        except Exception:
            logger.exception("detector %s failed", d.name)
            failed.append(d.name)
    return failed
