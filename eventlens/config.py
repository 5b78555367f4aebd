"""Options: defaults and how a caller's settings replace them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

# Thresholds and routing that define an incident.
SCORE_THRESHOLD = 0.8
SEVERITY_LEVELS = {"high": 0.9, "medium": 0.7, "low": 0.5}
SEVERITY_CHANNELS = {
    "high": ["email", "slack", "webhook"],
    "medium": ["slack", "webhook"],
    "low": ["webhook"],
}

# Rules written as conditions, first match wins.
CONDITION_RULES = [
    {"name": "high_confidence_anomaly", "condition": "confidence >= 0.95", "severity": "high", "auto_escalate": True},
    {"name": "medium_confidence_anomaly", "condition": "confidence >= 0.8", "severity": "medium", "auto_escalate": False},
    {"name": "low_confidence_anomaly", "condition": "confidence >= 0.6", "severity": "low", "auto_escalate": False},
]

# Seconds covered by one feature row, per family.
FAMILY_SECONDS = {"user": 3600, "network": 300, "syscall": 60, "cmdline": 3600}

DEFAULT_SCOPE_SECONDS = 3600
INCIDENT_SECONDS = 300


@dataclass(frozen=True)
class IncidentRules:
    """Score threshold, severity bounds and channels of incidents."""

    score_threshold: float = SCORE_THRESHOLD
    severity_levels: Mapping[str, float] = field(default_factory=lambda: dict(SEVERITY_LEVELS))
    channels: Mapping[str, list[str]] = field(default_factory=lambda: dict(SEVERITY_CHANNELS))
    window_seconds: int = INCIDENT_SECONDS

    @classmethod
    def from_config(cls, config: Mapping | None) -> "IncidentRules":
        """Rules of ``config['incident_rules']``; the defaults when there are none."""
        config = config or {}
        given = config.get("incident_rules") or {}
        rules = cls(window_seconds=config.get("incident_window_size", INCIDENT_SECONDS))
        if not given:
            return rules
        return replace(
            rules,
            score_threshold=given["anomaly_score_threshold"],
            severity_levels=dict(given["severity_levels"]),
            channels={k: list(v) for k, v in given["notification_channels"].items()},
        )


def enabled_channels(config: Mapping | None) -> list[str]:
    """Channels under ``config['notifications']``, less those switched off by ``enabled: false``."""
    known = ("email", "slack", "webhook")
    settings = (config or {}).get("notifications", {})
    return [c for c in known if c in settings and (settings[c] or {}).get("enabled", True)]


# Where settings switch feature families off (section, key -> family).
FAMILY_SWITCHES = {
    ("features", "user_behavior"): "user",
    ("features", "network_traffic"): "network",
    ("features", "system_calls"): "syscall",
    ("features", "command_line"): "cmdline",
    ("advanced_features", "text_features"): "text",
    ("advanced_features", "sequence_features"): "sequence",
    ("advanced_features", "correlation_features"): "correlation",
    ("advanced_features", "entropy_features"): "entropy",
}


def enabled_families(config: Mapping | None, families: Sequence[str]) -> list[str]:
    """``families`` without those that ``config`` switches off; families without a switch stay."""
    config = config or {}
    off = {
        family
        for (section, key), family in FAMILY_SWITCHES.items()
        if not (config.get(section, {}).get(key) or {}).get("enabled", True)
    }
    return [f for f in families if f not in off]


def scope_seconds(config: Mapping | None) -> int:
    """Width of a feature window."""
    return (config or {}).get("features", {}).get("window_size", DEFAULT_SCOPE_SECONDS)


def family_seconds(config: Mapping | None) -> dict[str, int]:
    """Width of each family's own window, where the settings name one."""
    given = (config or {}).get("features", {})
    names = {key: family for (section, key), family in FAMILY_SWITCHES.items() if section == "features"}
    named = {family: (given.get(key) or {}).get("window_size") for key, family in names.items()}
    return {**FAMILY_SECONDS, **{f: w for f, w in named.items() if w}}


def tfidf_options(config: Mapping | None) -> dict:
    """Keyword arguments of the TF-IDF features: number of terms, stop words and lengths of word runs, where the settings name them.

    ``advanced_features.tfidf_max_features`` goes before ``feature_extraction.text_features.max_features``.
    """
    config = config or {}
    text = (config.get("feature_extraction") or {}).get("text_features") or {}
    most = (config.get("advanced_features") or {}).get("tfidf_max_features", text.get("max_features", 100))
    options: dict = {"max_features": most}
    if "stop_words" in text and text["stop_words"] != "english":
        if isinstance(text["stop_words"], str):
            raise ValueError(f"stop words are english, a list or none, not {text['stop_words']}")
        options["stop_words"] = list(text["stop_words"] or [])
    if "ngram_range" in text:
        low, high = text["ngram_range"]
        if not 1 <= low <= high:
            raise ValueError(f"no range of word runs: {text['ngram_range']}")
        options["ngrams"] = (low, high)
    return options
