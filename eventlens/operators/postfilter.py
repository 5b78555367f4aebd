"""What a second scorer's results mean, per kind of model."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.functions.numbers import above

# The default thresholds of each kind.
THRESHOLDS = {"anomaly_detection": 0.5, "threat_detection": 0.7, "pattern_recognition": 0.6}


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def anomalies(results: DataFrame, threshold: float = THRESHOLDS["anomaly_detection"]) -> DataFrame:
    """Rows predicted anomalous with a score above the threshold; NaN is above none."""
    return results.where((F.col("prediction") == 1) & above(F.col("score"), threshold))


def behaviors(results: DataFrame) -> DataFrame:
    """Rows predicted anomalous, whatever the score, with ``behavior_type``."""
    kind = _or(results, "behavior_type", F.lit("unknown"))
    return results.where(F.col("prediction") == 1).withColumn("behavior_type", kind)


def threats(results: DataFrame, threshold: float = THRESHOLDS["threat_detection"]) -> DataFrame:
    """Rows predicted anomalous above the threshold, with ``threat_category`` and ``severity``."""
    return anomalies(results, threshold).withColumns(
        {
            "threat_category": _or(results, "threat_category", F.lit("unknown")),
            "severity": _or(results, "severity", F.lit("medium")),
        }
    )


def patterns(results: DataFrame, threshold: float = THRESHOLDS["pattern_recognition"]) -> DataFrame:
    """Rows predicted anomalous above the threshold, with ``pattern_type`` and ``pattern_details``."""
    return anomalies(results, threshold).withColumns(
        {
            "pattern_type": _or(results, "pattern_type", F.lit("unknown")),
            "pattern_details": _or(results, "pattern_details", F.create_map().cast("map<string,string>")),
        }
    )


KINDS: Mapping[str, Callable[..., DataFrame]] = {
    "anomaly_detection": anomalies,
    "behavior_analysis": behaviors,
    "threat_detection": threats,
    "pattern_recognition": patterns,
}


def post_filter(kind: str) -> Callable[..., DataFrame]:
    """The filter for a kind of model; an unknown kind raises."""
    if kind not in KINDS:
        raise ValueError(f"unknown model type: {kind}")
    return KINDS[kind]


def zip_results(batches: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, index, prediction, score) from the arrays ``predictions`` and ``scores``, cut to the shorter one."""
    shorter = F.least(F.size("predictions"), F.size("scores"))
    pairs = F.arrays_zip(
        F.slice("predictions", F.lit(1), shorter).alias("prediction"), F.slice("scores", F.lit(1), shorter).alias("score")
    )
    rows = batches.select(batch, F.posexplode_outer(pairs).alias("index", "pair")).where(F.col("index").isNotNull())
    return rows.select(batch, "index", F.col("pair")["prediction"].alias("prediction"), F.col("pair")["score"].alias("score"))


def attach_events(zipped: DataFrame, events: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Each zipped result with the event at its index, or nulls beyond the last event."""
    return zipped.join(events, [batch, "index"], "left")
