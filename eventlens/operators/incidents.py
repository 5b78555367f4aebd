"""Incidents: high-scoring events grouped by time window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventlens.config import IncidentRules
from eventlens.functions.numbers import above
from eventlens.functions.severity import severity_of
from eventlens.functions.time import floor_time, iso_text, micros
from eventlens.operators.joins import join_null_safe
from eventlens.operators.ordered import CHUNK, range_chunks
from eventlens.session import settle


def attach_scores(events: DataFrame, scores: DataFrame, keys: str | list[str] = "event_id") -> DataFrame:
    """Events with their ``prediction`` and ``score``: by an id, or by a list of scope columns.

    Scope columns may be null, an entity for example, and null then means null; an id may not.
    ``scores`` has one row per key.
    """
    plain = events.drop("prediction", "score")
    if isinstance(keys, str):
        return plain.join(scores.select(keys, "prediction", "score"), keys)
    return join_null_safe(plain, scores.select(*keys, "prediction", "score"), keys)


def _model_map(info: Mapping[str, str]) -> Column:
    pairs = [F.lit(str(x)) for key in sorted(info) for x in (key, info[key])]
    return F.create_map(*pairs).cast("map<string,string>")


def incident_id(window: Column, info: Mapping[str, str]) -> Column:
    """The same window and model always give the same id, so a repeated run changes nothing."""
    model = "|".join(f"{k}={info[k]}" for k in sorted(info))
    at = F.coalesce(iso_text(window), F.lit("None"))
    return F.substring(F.sha2(F.concat(at, F.lit(f"|{model}")), 256), 1, 32)


def high_score_events(scored: DataFrame, rules: IncidentRules = IncidentRules(), model_info: Mapping[str, str] | None = None) -> DataFrame:
    """Events strictly above the threshold with their window and the id of their incident.

    This table holds the incidents' events: an incident of any size is a set of rows, never a list.
    Events without a time share an incident without one. A NaN score is above no threshold.
    """
    hits = scored.where(above(F.col("score"), rules.score_threshold))
    return hits.withColumn("window", floor_time(F.col("timestamp"), rules.window_seconds)).withColumn(
        "incident_id", incident_id(F.col("window"), model_info or {})
    )


def moment(ts: Column, event_id: Column) -> Column:
    """One number that sorts like (time, id), which hash aggregation can take the minimum of."""
    return (micros(ts).cast("decimal(20,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + event_id).cast("decimal(38,0)")


def type_counts(hits: DataFrame, window: Column | str = "window") -> DataFrame:
    """(window, event_type, n, max_score, first) per window and type; ``first`` orders the types.

    A null type counts as ``None``; without the column all events are ``unknown``.
    """
    kind = F.coalesce("event_type", F.lit("None")) if "event_type" in hits.columns else F.lit("unknown")
    return hits.groupBy(window, kind.alias("event_type")).agg(
        F.count("*").alias("n"),
        F.max("score").alias("max_score"),
        F.min(moment(F.col("timestamp"), F.col("event_id"))).alias("first"),
    )


def description(total: Column, types: Column) -> Column:
    """One line for all events and one per type, in order of first appearance."""
    lines = F.transform(F.array_sort(types), lambda t: F.concat(F.lit("- "), t["n"], F.lit(" "), t["event_type"], F.lit(" events\n")))
    return F.concat(F.lit("Detected "), total, F.lit(" anomalous events:\n"), F.array_join(lines, ""))


def summarize(
    per_type: DataFrame, window: Column, rules: IncidentRules, model_info: Mapping[str, str] | None = None
) -> DataFrame:
    """Incident rows from per-type counts; only the types of a window come together in a list."""
    total = per_type.groupBy(window.alias("window")).agg(
        F.sum("n").alias("event_count"),
        F.max("max_score").alias("max_score"),
        F.collect_list(F.struct("first", "event_type", "n")).alias("types"),
    )
    start = F.col("window.start") if total.schema["window"].dataType.typeName() == "struct" else F.col("window")
    return total.select(
        incident_id(start, model_info or {}).alias("id"),
        F.concat(F.lit("Anomaly Detected: "), F.col("event_count"), F.lit(" events")).alias("title"),
        severity_of(F.col("max_score"), rules.severity_levels).alias("severity"),
        iso_text(start).alias("timestamp"),
        description(F.col("event_count"), F.col("types")).alias("description"),
        "max_score",
        "event_count",
        _model_map(model_info or {}).alias("model_info"),
    )


def detect_incidents(
    scored: DataFrame, rules: IncidentRules = IncidentRules(), model_info: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per window with at least one high-scoring event. Their events: ``high_score_events``."""
    per_type = type_counts(high_score_events(scored, rules, model_info))
    return summarize(per_type, F.col("window"), rules, model_info)


def list_incidents(
    incidents: DataFrame, severity: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Incidents newest first; bounds are ISO times, both inclusive."""
    ts = F.col("timestamp")
    if severity is not None:
        incidents = incidents.where(F.col("severity") == severity)
    if start is not None:
        incidents = incidents.where(ts >= start)
    if end is not None:
        incidents = incidents.where(ts <= end)
    return incidents.orderBy(F.desc("timestamp"), "id")


def get_incident(incidents: DataFrame, incident: str) -> DataFrame:
    """The row of one incident; raises when there is none."""
    found = incidents.where(F.col("id") == incident)
    if found.isEmpty():
        raise ValueError(f"incident {incident} not found")
    return found


def event_pages(hits: DataFrame, page_size: int = 500, chunks: int | None = None) -> DataFrame:
    """(incident_id, page, events): every event of an incident, in order, in lists of ``page_size``.

    An event's place is its place in its range chunk plus the rows of the incident's earlier chunks,
    so one huge incident is spread over many tasks and a repeated run cuts the same pages.
    """
    rows = range_chunks(hits, ["incident_id"], ["timestamp", "event_id"], chunks)
    inside = W.partitionBy(CHUNK, "incident_id").orderBy("timestamp", "event_id")
    # Written once: the counts and the rows below must see the same chunks.
    placed = settle(rows.withColumn("place", F.row_number().over(inside)))
    earlier = W.partitionBy("incident_id").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("incident_id", CHUNK).agg(F.count("*").alias("in_chunk"))
    offsets = counts.select("incident_id", CHUNK, F.coalesce(F.sum("in_chunk").over(earlier), F.lit(0)).alias("offset"))
    page = F.floor((F.col("offset") + F.col("place") - 1) / page_size).alias("page")
    event = F.struct(*[c for c in hits.columns if c not in ("incident_id", "window")]).alias("event")
    ordered = F.array_sort(F.collect_list(F.struct("event.timestamp", "event.event_id", "event")))
    return (
        placed.join(offsets, ["incident_id", CHUNK])
        .select("incident_id", page, event)
        .groupBy("incident_id", "page")
        .agg(F.transform(ordered, lambda e: e["event"]).alias("events"))
    )


def merge_alerts(first: DataFrame, second: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both alert tables, duplicates kept, within the inclusive bounds, newest first, then by id."""
    both = first.unionByName(second, allowMissingColumns=True)
    if start is not None:
        both = both.where(F.col("timestamp") >= F.lit(start).cast(both.schema["timestamp"].dataType))
    if end is not None:
        both = both.where(F.col("timestamp") <= F.lit(end).cast(both.schema["timestamp"].dataType))
    return both.orderBy(F.desc("timestamp"), "id")
