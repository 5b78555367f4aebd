"""From events to incidents: features per scope, forest scores, scores back on events, incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from eventlens.config import DEFAULT_SCOPE_SECONDS, FAMILY_SECONDS, IncidentRules, enabled_families, scope_seconds, tfidf_options
from eventlens.operators import features, incidents
from eventlens.operators.detector import Detector
from eventlens.session import settle

# Features that exist in every scope, whatever values the events hold.
MODEL_FEATURES = (
    "source_ip_count",
    "source_ip_max_frequency",
    "source_ip_mean_frequency",
    "destination_ip_count",
    "user_count",
    "user_max_activity",
    "unique_commands",
    "command_entropy",
    "unique_files_accessed",
    "file_access_entropy",
    "process_count",
    "process_max_frequency",
    "high_severity_count",
    "failed_login_count",
    "total_packets",
    "total_bytes",
    "unique_connections",
    "protocol_entropy",
    "unique_syscalls",
    "syscall_entropy",
    "avg_execution_time",
    "std_execution_time",
)


@dataclass(frozen=True)
class Detection:
    """What a run produces."""

    model: Detector
    scopes: DataFrame
    events: DataFrame
    incidents: DataFrame


def basic_matrix(
    events: DataFrame,
    by: Sequence[str],
    names: Sequence[str] = MODEL_FEATURES,
    failed_login: str = "failed_login",
    families: Sequence[str] = features.BASIC,
    **tfidf_options,
) -> DataFrame:
    """The basic families, or those that are given, as one wide row per scope."""
    return features.wide_features(events, by, names, families, failed_login, **tfidf_options)


def family_windows(
    events: DataFrame, seconds: Mapping[str, int] = FAMILY_SECONDS, failed_login: str = "failed_login"
) -> DataFrame:
    """(family, scope, feature, value) with a window width of its own for each family.

    Basic families share one scan of their fields, whatever their widths; with others, families of one width share a pass.
    """
    if set(seconds) <= set(features.BASIC):
        return features.windowed_features(events, dict(seconds), failed_login)
    parts = [
        features.extract(features.with_scope(events, width), ["scope"], [f for f, own in seconds.items() if own == width], failed_login)
        for width in sorted(set(seconds.values()))
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("family", "scope", "feature", "value")


def detect(
    events: DataFrame,
    entity: Sequence[str] = (),
    seconds: int = DEFAULT_SCOPE_SECONDS,
    names: Sequence[str] = MODEL_FEATURES,
    rules: IncidentRules = IncidentRules(),
    model: Detector | None = None,
    failed_login: str = "failed_login",
    config: Mapping | None = None,
    families: Sequence[str] = features.BASIC,
) -> Detection:
    """Score every scope (and entity) and raise incidents from the events of high-scoring ones.

    Without a ``model`` one is trained on these scopes. Incident scores rise with anomaly: they are
    the negative forest scores, in [0, 1]. A ``config`` sets the window, which of the ``families`` are on, how
    terms are weighted, and the rules instead; features of families that it switches off are 0.
    """
    if config is not None:
        seconds, rules = scope_seconds(config), IncidentRules.from_config(config)
        families = enabled_families(config, families)
    scoped = features.with_scope(events, seconds)
    by = ["scope", *entity]
    matrix = settle(basic_matrix(scoped, by, names, failed_login, families, **(tfidf_options(config) if "text" in families else {})))
    model = model or Detector.fit(matrix, by, names)
    scopes = model.predict(matrix).withColumn("score", F.lit(0.0) - F.col("score"))
    scored = incidents.attach_scores(scoped, scopes, by)
    info = {"model_type": model.info["model_type"], "model_version": model.info["model_version"]}
    return Detection(model, scopes, scored, incidents.detect_incidents(scored, rules, info))
