"""Blending of local scores with a second scorer's scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from eventlens.functions.numbers import above

METHODS = ("weighted", "voting")
ORIENTATIONS = ("higher_is_anomalous", "raw")


@dataclass
class Ensemble:
    """Weight of the local score, the rest going to the second one.

    Local scores fall when a row is anomalous, second scores rise. ``orientation='raw'`` adds them
    as they are; the default turns the local score around first.
    """

    local_weight: float = 0.5
    method: str = "weighted"
    orientation: str = "higher_is_anomalous"

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown ensemble method: {self.method}")
        if self.orientation not in ORIENTATIONS:
            raise ValueError(f"unknown orientation: {self.orientation}")
        self.update_weights(self.local_weight)

    def update_weights(self, local_weight: float) -> None:
        if not 0 <= local_weight <= 1:
            raise ValueError("weight must be between 0 and 1")
        self.local_weight = local_weight

    def combine(self, local: DataFrame, second: DataFrame, key: str = "event_id", how: str = "inner") -> DataFrame:
        """(key, prediction, score) for the keys in both tables, or those of ``how``; a NaN score is no anomaly.

        ``local`` and ``second`` hold (key, prediction, score); the key is unique in each.
        """
        w = F.lit(float(self.local_weight))
        sign = F.lit(1.0 if self.orientation == "raw" else -1.0)
        pair = local.select(key, F.col("prediction").alias("p1"), F.col("score").alias("s1")).join(
            second.select(key, F.col("prediction").alias("p2"), F.col("score").alias("s2")), key, how
        )
        blended = w * sign * F.col("s1") + (1 - w) * F.col("s2")
        votes = w * F.col("p1") + (1 - w) * F.col("p2")
        decided = blended if self.method == "weighted" else votes
        return pair.select(key, above(decided, 0.5).cast("int").alias("prediction"), blended.alias("score"))
