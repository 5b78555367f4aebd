"""Drift of score distributions and of evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.functions.numbers import above, known
from eventlens.operators.ranked import first_ranked

DRIFT_THRESHOLD = 0.1
HISTORY_SIZE = 1000
METRICS = ("precision", "recall", "f1", "roc_auc")


def score_summary(df: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """(by, mean_score, std_score, min_score, max_score); the deviation is the population one. Null and NaN scores are missing."""
    value = known(F.col(score))
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean_score"),
        F.stddev_pop(value).alias("std_score"),
        F.min(value).alias("min_score"),
        F.max(value).alias("max_score"),
    )


def missing_scores(df: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """(by, rows, missing): how many scores ``score_summary`` leaves out."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(known(F.col(score)).isNull()).alias("missing"))


def score_drift(
    current: DataFrame, baseline_mean: Column, baseline_std: Column, threshold: float = DRIFT_THRESHOLD
) -> DataFrame:
    """Summary rows with ``mean_drift``, ``std_drift``, ``drift_metric`` and ``drift_detected``.

    Both are shares of the baseline's deviation; with a deviation of 0 they are null.
    """
    mean_drift = F.try_divide(F.abs(F.col("mean_score") - baseline_mean), baseline_std)
    std_drift = F.try_divide(F.abs(F.col("std_score") - baseline_std), baseline_std)
    return (
        current.withColumn("mean_drift", mean_drift)
        .withColumn("std_drift", std_drift)
        .withColumn("drift_metric", F.greatest("mean_drift", "std_drift"))
        .withColumn("drift_detected", above(F.col("drift_metric"), threshold))
    )


def newest(history: DataFrame, keep: int = HISTORY_SIZE, by: Sequence[str] = (), ts: str = "timestamp", *, tie: str) -> DataFrame:
    """The newest ``keep`` records, per group or of the whole table; ``tie`` decides between equal times."""
    return first_ranked(history, by, [F.desc(ts), F.desc(tie)], keep)


def latest(history: DataFrame, ts: str = "timestamp", *, tie: str) -> DataFrame:
    """The last record; ``tie`` decides between equal times."""
    return history.agg(F.max_by(F.struct(*history.columns), F.struct(ts, tie)).alias("r")).select("r.*")


def record(drifts: DataFrame, timestamp: Column | str) -> DataFrame:
    """A row of ``score_drift`` as a record of the drift history, with the time given for it."""
    at = F.lit(timestamp).cast("timestamp_ntz") if isinstance(timestamp, str) else timestamp
    return drifts.select(at.alias("timestamp"), "drift_metric", "mean_drift", "std_drift", "drift_detected")


def metric_drift(reference: DataFrame, current: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """(metric, drift, exceeds) for the compared metrics that are in both (metric, value) tables."""
    compared = F.col("metric").isin(list(METRICS))
    pair = reference.where(compared).select("metric", F.col("value").alias("r")).join(
        current.where(compared).select("metric", F.col("value").alias("c")), "metric"
    )
    drift = F.abs(F.col("r") - F.col("c"))
    return pair.select("metric", drift.alias("drift"), above(drift, threshold).alias("exceeds"))


def drift_detected(metrics: DataFrame) -> DataFrame:
    """One row: does any metric exceed the threshold?"""
    return metrics.agg(F.coalesce(F.bool_or("exceeds"), F.lit(False)).alias("drift_detected"))
