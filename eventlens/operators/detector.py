"""The trained detector: scaling, forest and cutoff together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from eventlens.operators import drift, forest as iforest
from eventlens.operators.ordered import exact_quantile
from eventlens.operators.scaling import Scaler, fill_with_mean, fill_with_zero
from eventlens.session import settle

MODEL_TYPE = "IsolationForest"
MODEL_VERSION = "1.0.0"


@dataclass(frozen=True)
class Detector:
    """Scaler, forest, score offset and facts about the training."""

    scaler: Scaler
    forest: iforest.Forest
    offset: float
    info: dict = field(default_factory=dict)

    @property
    def features(self) -> tuple[str, ...]:
        return self.scaler.features

    @classmethod
    def fit(
        cls,
        matrix: DataFrame,
        key: Sequence[str],
        features: Sequence[str] | None = None,
        contamination: float = iforest.CONTAMINATION,
        trees: int = iforest.TREES,
        sample: int = iforest.SAMPLE,
        seed: int = iforest.SEED,
        scaler: Scaler | None = None,
        now: str | None = None,
    ) -> "Detector":
        """Train on a feature matrix whose ``key`` is unique.

        A given ``scaler`` is kept with its feature list, as in a second training. The matrix is
        read several times, so hand over a stored or settled one. The driver receives the scaling,
        the node table and the summary of the scores, none of which grows with the rows.
        """
        names = list(scaler.features if scaler else features or [c for c in matrix.columns if c not in key])
        cls._require(matrix, names)
        filled = fill_with_zero(matrix.select(*key, *names), names)
        scaler = scaler or Scaler.fit(filled, names)
        scaled = scaler.transform(filled)
        grown = iforest.fit_forest(scaled, key, names, trees, sample, seed)
        scores = settle(iforest.score(scaled, grown).select("score"))
        cut = exact_quantile(scores, "score", contamination).first()
        summary = drift.score_summary(scores).first().asDict()
        info = {
            "model_type": MODEL_TYPE,
            "model_version": MODEL_VERSION,
            "training_samples": int(cut["n"]),
            "last_trained": now,
            "performance_metrics": {k: float(v) for k, v in summary.items()},
        }
        return cls(scaler, grown, float(cut["quantile"]), info)

    @staticmethod
    def _require(df: DataFrame, names: Sequence[str]) -> None:
        absent = [n for n in names if n not in df.columns]
        if absent:
            raise ValueError(f"features not found: {', '.join(absent)}")

    def predict(self, matrix: DataFrame, raw: bool = False, fill: str = "zero") -> DataFrame:
        """``matrix`` with ``prediction`` and ``score`` (lower is more anomalous).

        ``fill='mean'`` and ``raw=True`` give the serving form: nulls become the batch's column
        means and labels are -1 and 1. Works on streams, except with ``fill='mean'``.
        """
        self._require(matrix, self.features)
        keep = [c for c in matrix.columns if c not in self.features]
        fill_nulls = fill_with_mean if fill == "mean" else fill_with_zero
        filled = fill_nulls(matrix.select(*keep, *self.features), list(self.features))
        scored = iforest.score(self.scaler.transform(filled), self.forest).select(*keep, "score")
        return scored.withColumn("prediction", iforest.label(F.col("score"), self.offset, raw))

    def drift(self, scored: DataFrame, by: Sequence[str] = (), threshold: float = drift.DRIFT_THRESHOLD) -> DataFrame:
        """Drift of the score distribution against the training scores."""
        base = self.info["performance_metrics"]
        current = drift.score_summary(scored, by)
        return drift.score_drift(current, F.lit(base["mean_score"]), F.lit(base["std_score"]), threshold)

    def summary(self, matrix: DataFrame, ensemble: Mapping | None = None) -> DataFrame:
        """One row about the model, with its drift on ``matrix``; ``ensemble`` adds the blend's settings."""
        now = self.drift(self.predict(matrix)).select(
            F.struct("drift_metric", "mean_drift", "std_drift", "drift_detected").alias("current_drift")
        )
        metrics = F.create_map(*[F.lit(x) for kv in sorted(self.info["performance_metrics"].items()) for x in kv])
        row = now.select(
            F.lit(self.info["model_type"]).alias("model_type"),
            F.lit(self.info["model_version"]).alias("model_version"),
            F.lit(len(self.features)).alias("feature_count"),
            F.array(*[F.lit(f) for f in self.features]).alias("features"),
            F.lit(True).alias("is_trained"),
            F.lit(self.info["last_trained"]).cast("string").alias("last_trained"),
            F.lit(self.info["training_samples"]).cast("bigint").alias("training_samples"),
            metrics.alias("performance_metrics"),
            "current_drift",
        )
        if ensemble is None:
            return row
        w = float(ensemble.get("local_weight", 0.5))
        return row.withColumn(
            "ensemble",
            F.struct(
                F.lit(w).alias("local_weight"),
                F.lit(1 - w).alias("second_weight"),
                F.lit(ensemble.get("method", "weighted")).alias("method"),
            ),
        )
