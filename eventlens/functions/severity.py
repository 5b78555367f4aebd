"""Severity of a score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from eventlens.config import CONDITION_RULES, SEVERITY_LEVELS
from eventlens.functions.numbers import known


def severity_of(score: Column, levels: Mapping[str, float] = SEVERITY_LEVELS) -> Column:
    """``high``, ``medium``, ``low`` (bounds inclusive) or ``info``, also for null and NaN."""
    score, bucket = known(score), F.lit("info")
    for name in ("low", "medium", "high"):
        bucket = F.when(score >= levels[name], name).otherwise(bucket)
    return bucket


def rule_severity(rules: Sequence[Mapping] = CONDITION_RULES) -> Column:
    """Struct (rule, severity, auto_escalate) of the first rule whose SQL condition holds, else null."""
    found = F.lit(None)
    for rule in reversed(rules):
        hit = F.struct(
            F.lit(rule["name"]).alias("rule"),
            F.lit(rule["severity"]).alias("severity"),
            F.lit(bool(rule.get("auto_escalate", False))).alias("auto_escalate"),
        )
        found = F.when(F.expr(rule["condition"]), hit).otherwise(found)
    return found
