"""Stream transformations. Each takes a streaming (or batch) DataFrame of events and returns one.

Event times are naive in tables, but watermarks need TIMESTAMP, so streams carry ``timestamp`` cast
to it. Windows are emitted once the watermark has passed them (append mode).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.config import IncidentRules
from eventlens.functions.entropy import SMOOTHING, entropy_basic, entropy_of_sizes, sizes_total
from eventlens.functions.numbers import above, known
from eventlens.operators import incidents
from eventlens.operators.detector import Detector

DELAY = "10 minutes"


def watermarked(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events with a watermark on ``timestamp``; later ones than the delay are dropped by Spark."""
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def _window(seconds: int):
    return F.window("timestamp", f"{seconds} seconds")


def windowed_features(events: DataFrame, seconds: int = 3600, failed_login: str = "failed_login", delay: str = DELAY) -> DataFrame:
    """(scope, event counts, sums and means) per window."""
    return (
        watermarked(events, delay)
        .groupBy(_window(seconds).alias("w"))
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("event_type") == failed_login).alias("failed_login_count"),
            F.count_if(F.col("alert_level") >= 12).alias("high_severity_count"),
            F.sum("packet_count").alias("total_packets"),
            F.sum("byte_count").alias("total_bytes"),
            F.avg(known(F.col("execution_time"))).alias("avg_execution_time"),
        )
        .select(F.col("w.start").alias("scope"), "*")
        .drop("w")
    )


def windowed_entropy(events: DataFrame, field: str, seconds: int = 3600, delay: str = DELAY) -> DataFrame:
    """(scope, distinct, max_frequency, entropy) of one field per window.

    Two chained aggregations: counts per value, then their statistics per window.
    """
    timed = F.when(F.col("timestamp").isNotNull(), F.col(field))
    per_value = (
        watermarked(events, delay)
        .where(timed.isNotNull())
        .groupBy(_window(seconds).alias("w"), F.col(field).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return (
        per_value.groupBy(F.window(F.window_time("w"), f"{seconds} seconds").alias("w2"))
        .agg(
            F.count("*").alias("distinct"),
            F.max("n").alias("max_frequency"),
            entropy_basic(F.col("n"), F.lit(1)).alias("entropy"),
        )
        .select(F.col("w2.start").alias("scope"), "distinct", "max_frequency", "entropy")
    )


def windowed_fields(events: DataFrame, fields: Sequence[str], seconds: int = 3600, delay: str = DELAY) -> DataFrame:
    """(scope, field, rows, distinct, max_frequency, mean_frequency, entropy) of every field per window.

    One unpivot and two chained aggregations for all fields: counts per value, then their statistics.
    """
    return (
        _value_counts(events, fields, seconds, delay)
        .groupBy(F.window(F.window_time("w"), f"{seconds} seconds").alias("w2"), "field")
        .agg(
            F.sum("n").alias("rows"),
            F.count("*").alias("distinct"),
            F.max("n").alias("max_frequency"),
            F.avg("n").alias("mean_frequency"),
            entropy_basic(F.col("n"), F.lit(1)).alias("entropy"),
        )
        .select(F.col("w2.start").alias("scope"), "field", "rows", "distinct", "max_frequency", "mean_frequency", "entropy")
    )


def windowed_entropies(events: DataFrame, fields: Sequence[str], seconds: int = 3600, delay: str = DELAY) -> DataFrame:
    """(scope, field, rows, distinct, max_frequency, mean_frequency, entropy, entropy_smoothed) of every field per window.

    The smoothed entropy needs a window's total beside its values' counts. Three chained aggregations hold
    both: counts of values, then how many values have each count, then per window and field the list of
    these pairs. N events have at most sqrt(2N) different counts, so that is the list's length.
    """
    again = f"{seconds} seconds"
    sizes = (
        _value_counts(events, fields, seconds, delay)
        .groupBy(F.window(F.window_time("w"), again).alias("w2"), "field", "n")
        .agg(F.count("*").alias("m"))
    )
    listed = sizes.groupBy(F.window(F.window_time("w2"), again).alias("w3"), "field").agg(
        F.sum("m").alias("distinct"),
        F.max("n").alias("max_frequency"),
        F.array_sort(F.collect_list(F.struct("n", "m"))).alias("sizes"),
    )
    totals = listed.withColumn("rows", sizes_total(F.col("sizes")))
    rows = F.col("rows")
    return totals.select(
        F.col("w3.start").alias("scope"),
        "field",
        "rows",
        "distinct",
        "max_frequency",
        (rows / F.col("distinct")).alias("mean_frequency"),
        entropy_of_sizes(F.col("sizes"), rows).alias("entropy"),
        entropy_of_sizes(F.col("sizes"), rows, SMOOTHING).alias("entropy_smoothed"),
    )


def windowed_transitions(
    events: DataFrame,
    kinds: Mapping[str, str],
    seconds: int = 3600,
    delay: str = DELAY,
    slice_seconds: int = 60,
    tie: str = "event_id",
) -> DataFrame:
    """(scope, kind, transition, n): how often one value of a column directly follows another inside a window.

    ``kinds`` maps a kind to its column. Windows are cut into slices of ``slice_seconds`` (or the largest part of
    it that divides the window). The state keeps the events of open slices only; once the watermark has
    passed a slice, its events are put in order, and counts of its steps and its first and last event go on.
    The next state holds a window's counts and one such edge per slice, and when the window is closed the
    edges are joined up. So the events in state are bounded by the delay and a slice, not by the window, and
    a window's slices are spread over the tasks. A null value counts as the text ``None``.
    """
    if slice_seconds < 1 or not kinds:
        raise ValueError("give at least one kind, and slices of at least a second")
    width, whole = gcd(seconds, slice_seconds), f"{seconds} seconds"
    event = F.struct("timestamp", tie, *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(k) for k, c in kinds.items()])
    sliced = (
        watermarked(events, delay)
        .where(F.col("timestamp").isNotNull())
        .groupBy(_window(width).alias("s"))
        .agg(F.array_sort(F.collect_list(event)).alias("rows"))
        .select(F.col("s"), "rows", F.size("rows").alias("size"))
    )
    rows, size = F.col("rows"), F.col("size")
    none = F.lit(None).cast("string")
    places = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))

    def inside(kind: str) -> Column:
        """The steps of a kind between neighbours of a slice."""
        step = lambda i: _step(F.get(rows, i - 1)[kind], F.get(rows, i)[kind])
        return F.transform(places, lambda i: F.struct(F.lit(kind).alias("kind"), step(i).alias("transition"), none.alias("first"), none.alias("last")))

    entries = []
    for kind in kinds:
        edge = F.struct(F.lit(kind).alias("kind"), none.alias("transition"), F.get(rows, F.lit(0))[kind].alias("first"), F.get(rows, size - 1)[kind].alias("last"))
        entries += [inside(kind), F.array(edge)]
    counted = (
        sliced.select("s", F.inline(F.concat(*entries)))
        .groupBy(F.window(F.window_time("s"), whole).alias("w"), "kind", "transition")
        .agg(
            F.count("transition").alias("n"),
            F.array_sort(F.collect_list(F.when(F.col("transition").isNull(), F.struct(F.col("s.start").alias("at"), "first", "last")))).alias("edges"),
        )
    )
    edges = F.col("edges")
    across = F.transform(
        F.when(F.size(edges) > 1, F.sequence(F.lit(1), F.size(edges) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(_step(F.get(edges, i - 1)["last"], F.get(edges, i)["first"]).alias("transition"), F.lit(1).cast("bigint").alias("n")),
    )
    own = F.array(F.struct("transition", "n"))
    joined = counted.select("w", "kind", F.inline(F.when(F.col("transition").isNull(), across).otherwise(own)))
    return (
        joined.groupBy(F.window(F.window_time("w"), whole).alias("w2"), "kind", "transition")
        .agg(F.sum("n").alias("n"))
        .select(F.col("w2.start").alias("scope"), "kind", "transition", "n")
    )


def _step(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("->"), b)


def windowed_values(events: DataFrame, fields: Sequence[str], seconds: int = 3600, delay: str = DELAY) -> DataFrame:
    """(scope, field, value, n): how often each value of the fields occurs per window."""
    return _value_counts(events, fields, seconds, delay).select(F.col("w.start").alias("scope"), "field", "value", "n")


def _value_counts(events: DataFrame, fields: Sequence[str], seconds: int, delay: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    named = watermarked(events, delay).select("timestamp", F.inline(pairs))
    timed = F.when(F.col("timestamp").isNotNull(), F.col("value"))
    return named.where(timed.isNotNull()).groupBy(_window(seconds).alias("w"), "field", "value").agg(F.count("*").alias("n"))


def stream_incidents(
    scored: DataFrame, rules: IncidentRules = IncidentRules(), model_info: Mapping[str, str] | None = None, delay: str = DELAY
) -> DataFrame:
    """Incidents of closed windows, equal to the batch ones."""
    # The condition names the time, or Spark would filter first and only hits would move the watermark.
    timed = F.when(F.col("timestamp").isNotNull(), F.col("score"))
    hits = watermarked(scored, delay).where(above(timed, rules.score_threshold))
    per_type = incidents.type_counts(hits, _window(rules.window_seconds).alias("w"))
    again = F.window(F.window_time("w"), f"{rules.window_seconds} seconds")
    return incidents.summarize(per_type, again, rules, model_info)


def deduplicated(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event id once, as long as its repeats arrive within the watermark."""
    return watermarked(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def scored_stream(rows: DataFrame, model: Detector) -> DataFrame:
    """Feature rows with score and label; no state."""
    return model.predict(rows)
