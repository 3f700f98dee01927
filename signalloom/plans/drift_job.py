"""Drift of recent traffic against a training baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import drift, features
from ..session import cut_lineage
from ..sources import scans


def training_baseline(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Baseline of the feature rows of a labelled history; the features are written once and read per statistic."""
    train = cut_lineage(features.training_dataset(rows, contents).select(*features.FEATURES))
    return cut_lineage(drift.build_baseline(train, features.NUMERIC, features.CATEGORICAL))


def observed_features(rows: DataFrame, contents: DataFrame, *, newest: int = scans.DRIFT_ROWS) -> DataFrame:
    """Features of the newest VIDEO rows, primed by earlier rows of the same users."""
    recent = scans.recent_global(rows, newest)
    video = recent.where(F.col("content_type") != "LIVE")
    primed = features.with_warmup(video, scans.warmup_before(rows, recent), contents)
    return cut_lineage(primed.select(*features.FEATURES))


def drift_of(observed: DataFrame, baseline: DataFrame, numeric=None, categorical=None) -> DataFrame:
    """Drift of any table of feature rows, recent traffic or rows the caller supplies."""
    return drift.evaluate_drift(baseline, observed, numeric or features.NUMERIC, categorical or features.CATEGORICAL)


def drift_from_recent(rows: DataFrame, contents: DataFrame, baseline: DataFrame) -> DataFrame:
    return drift_of(observed_features(rows, contents), baseline)
