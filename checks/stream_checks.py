"""Stream forms, run to their end over the ``events`` table and compared with plain SQL on closed windows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from checks.detection_checks import BY_HAND_SQL, by_hand
from checks.feature_checks import counts
from checks.incident_checks import INCIDENTS, MODEL, RULES
from checks.registry import query, rounded
from checks.sample import EV, FAILED_LOGIN, SC, project, table
from eventlens.session import new_path
from eventlens.sources.streams import stream_table
from eventlens.streaming import queries, sinks

# A window is closed when it ended before the watermark: the newest event less the delay.
CLOSED = "(SELECT max(timestamp) - INTERVAL '10 minutes' FROM ev)"


def _stream(spark, sf):
    return project(stream_table(spark, sf, table(spark, sf, "events").schema, "events.parquet"))


# A stream that comes in parts: so many parts, each of as many files of about so many rows as it takes, but of so many at least.
PARTS, FILES, FILE_ROWS = 4, 2, 250_000


def _parts(spark, sf, change=lambda df: df, file_rows=FILE_ROWS):
    """All events in parts of rising times, cut at quantiles of the table, one part per micro-batch. ``change`` edits the raw table.

    A part is written and read by as many tasks as it has files, so their number grows with the table.
    """
    path = new_path(spark, "event-parts")
    raw = change(table(spark, sf, "events"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = raw.select(at.cast("double").alias("at")).approxQuantile("at", [i / PARTS for i in range(1, PARTS)], 0.01)
    part = sum((F.coalesce(at >= F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    files = max(FILES, ceil(raw.count() / (PARTS * file_rows)))
    for i in range(PARTS):
        rows = raw.where(part == i)
        rows.repartition(files).write.mode("append").parquet(path)
        # A part of few rows leaves files out. Empty ones stand in, or its batch would take files of the next part.
        for _ in range((i + 1) * files - len(spark.read.schema(raw.schema).parquet(path).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return project(stream_table(spark, path, raw.schema, files_per_batch=files))


FIELDS = ("event_type", "username", "process_name", "source_ip", "destination_ip", "alert_level", "command", "file_path", "protocol", "syscall")


@query(
    "stream_fields",
    f"WITH {SC} "
    + "\nUNION ALL\n".join(
        f"SELECT scope, '{f}' AS field, CAST(sum(n) AS BIGINT) AS rows, count(v) AS \"distinct\", max(n) AS max_frequency, round(avg(n), 6) AS mean_frequency, "
        f"round(0 - sum(p * log2(p)), 6) + 0.0 AS entropy FROM {counts(f)} WHERE v IS NOT NULL AND scope + INTERVAL '1 hour' <= {CLOSED} GROUP BY scope"
        for f in FIELDS
    ),
)
def _(spark, sf):
    return _naive(sinks.collect_table(spark, queries.windowed_fields(_parts(spark, sf), FIELDS), "stream-fields"), "scope")


def _smoothed(field):
    return (
        f"SELECT scope, '{field}' AS field, CAST(sum(n) AS BIGINT) AS rows, count(v) AS \"distinct\", max(n) AS max_frequency, round(avg(n), 6) AS mean_frequency, "
        f"round(0 - sum(p * log2(p)), 6) + 0.0 AS entropy, round(0 - sum(p * log2(p + 1e-10)), 6) + 0.0 AS entropy_smoothed "
        f"FROM {counts(field)} WHERE v IS NOT NULL AND scope + INTERVAL '1 hour' <= {CLOSED} GROUP BY scope"
    )


@query("stream_entropy_smoothed", f"WITH {SC} " + "\nUNION ALL\n".join(map(_smoothed, FIELDS)))
def _(spark, sf):
    found = _naive(sinks.collect_table(spark, queries.windowed_entropies(_parts(spark, sf), FIELDS), "stream-entropies"), "scope")
    return found.withColumns({c: F.col(c) + 0.0 for c in ("entropy", "entropy_smoothed")})


def _transitions(kind, column):
    following = f"lead(coalesce(CAST({column} AS VARCHAR), 'None')) OVER (PARTITION BY scope ORDER BY timestamp, event_id)"
    return f"SELECT scope, '{kind}' AS kind, coalesce(CAST({column} AS VARCHAR), 'None') AS a, {following} AS b FROM sc"


@query(
    "stream_transitions_state",
    f"WITH {SC}, pr AS ({_transitions('event', 'event_type')} UNION ALL {_transitions('command', 'command')}) "
    f"SELECT scope, kind, concat(a, '->', b) AS transition, count(*) AS n FROM pr WHERE b IS NOT NULL AND scope + INTERVAL '1 hour' <= {CLOSED} GROUP BY ALL",
)
def _(spark, sf):
    kinds = {"event": "event_type", "command": "command"}
    return _naive(sinks.collect_table(spark, queries.windowed_transitions(_parts(spark, sf), kinds), "stream-steps"), "scope")


@query(
    "nan_stream",
    f"WITH {SC} SELECT scope, count(*) AS events, round(avg(execution_time) FILTER (event_id % 11 <> 0), 6) AS avg_execution_time FROM sc "
    f"GROUP BY scope HAVING scope + INTERVAL '1 hour' <= {CLOSED}",
)
def _(spark, sf):
    spoilt = F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value"))
    stream = queries.windowed_features(_parts(spark, sf, lambda raw: raw.withColumn("value", spoilt)), failed_login=FAILED_LOGIN)
    return _naive(sinks.collect_table(spark, stream, "nan-stream"), "scope").select("scope", "events", "avg_execution_time")


@query(
    "stream_values",
    f"WITH {SC}, u AS (SELECT scope, unnest([{', '.join(repr(f) for f in FIELDS[:1])}, 'alert_level', 'protocol']) AS field, "
    "unnest([event_type, CAST(alert_level AS VARCHAR), protocol]) AS value FROM sc) "
    f"SELECT scope, field, value, count(*) AS n FROM u WHERE scope + INTERVAL '1 hour' <= {CLOSED} GROUP BY ALL",
)
def _(spark, sf):
    fields = ("event_type", "alert_level", "protocol")
    return _naive(sinks.collect_table(spark, queries.windowed_values(_parts(spark, sf), fields), "stream-values"), "scope")


def _naive(df, *columns):
    return rounded(df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns}))


@query(
    "stream_features",
    f"WITH {SC} SELECT scope, count(*) AS events, count(*) FILTER (event_type = 'error') AS failed_login_count, "
    "count(*) FILTER (alert_level >= 12) AS high_severity_count, CAST(sum(packet_count) AS BIGINT) AS total_packets, "
    "CAST(sum(byte_count) AS BIGINT) AS total_bytes, round(avg(execution_time), 6) AS avg_execution_time FROM sc "
    f"GROUP BY scope HAVING scope + INTERVAL '1 hour' <= {CLOSED}",
)
def _(spark, sf):
    stream = queries.windowed_features(_stream(spark, sf), failed_login=FAILED_LOGIN)
    return _naive(sinks.collect_table(spark, stream, "stream-features"), "scope")


@query(
    "stream_entropy",
    f"WITH {SC} SELECT scope, count(v) AS \"distinct\", max(n) AS max_frequency, round(0 - sum(p * log2(p)), 6) + 0.0 AS entropy "
    f"FROM {counts('command')} WHERE v IS NOT NULL AND scope + INTERVAL '1 hour' <= {CLOSED} GROUP BY scope",
)
def _(spark, sf):
    stream = queries.windowed_entropy(_stream(spark, sf), "command")
    return _naive(sinks.collect_table(spark, stream, "stream-entropy"), "scope")


@query(
    "stream_transitions",
    f"WITH {SC}, pr AS (SELECT scope, concat(event_type, '->', lead(event_type) OVER (PARTITION BY scope ORDER BY timestamp, event_id)) AS transition, "
    "lead(event_type) OVER (PARTITION BY scope ORDER BY timestamp, event_id) AS b FROM sc) "
    f"SELECT scope, transition, count(*) AS n FROM pr WHERE b IS NOT NULL AND scope + INTERVAL '1 hour' <= {CLOSED} GROUP BY ALL",
)
def _(spark, sf):
    path = new_path(spark, "stream-transitions")
    columns = ["timestamp", "event_id", "event_type"]
    sinks.finish(sinks.stage_by_window(_stream(spark, sf), f"{path}/staged", 3600, columns, f"{path}/state"))
    staged = spark.read.parquet(f"{path}/staged")
    counted = sinks.closed_transitions(staged, 3600, 600, {"event": F.col("event_type")})
    return counted.select("scope", "transition", "n")


@query(
    "stream_incidents",
    f"WITH {INCIDENTS} SELECT id, title, severity, timestamp, description, max_score, event_count FROM inc "
    "WHERE CAST(timestamp AS TIMESTAMP) + INTERVAL '300 seconds' <= (SELECT max(timestamp) - INTERVAL '10 minutes' FROM ev)",
)
def _(spark, sf):
    found = queries.stream_incidents(_stream(spark, sf), RULES, MODEL)
    return sinks.collect_table(spark, found.drop("model_info"), "stream-incidents")


@query("stream_dedup", f"WITH {EV} SELECT event_id, timestamp, event_type FROM ev")
def _(spark, sf):
    repeated = _stream(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("copy")
    stream = queries.deduplicated(repeated).select("event_id", "timestamp", "event_type")
    return _naive(sinks.collect_table(spark, stream, "stream-dedup"), "timestamp")


@query("stream_scores", BY_HAND_SQL)
def _(spark, sf):
    _, model = by_hand(spark, sf)
    raw = stream_table(spark, sf, table(spark, sf, "embeddings").schema, "embeddings.parquet")
    cells = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(model.features)]
    scored = queries.scored_stream(raw.select("vec_id", *cells), model)
    return rounded(sinks.collect_table(spark, scored, "stream-scores"))


@query(
    "stream_drift",
    f"WITH {EV} SELECT CAST(0 AS BIGINT) AS batch_id, round(greatest(abs(avg(score) - 0.4) / 0.25, abs(stddev_pop(score) - 0.25) / 0.25), 6) AS drift_metric, "
    "greatest(abs(avg(score) - 0.4) / 0.25, abs(stddev_pop(score) - 0.25) / 0.25) > 0.1 AS drift_detected FROM ev",
)
def _(spark, sf):
    path = new_path(spark, "stream-drift")
    handle = sinks.record_drift(f"{path}/history", 0.4, 0.25)
    sinks.finish(sinks.run_batches(_stream(spark, sf), handle, f"{path}/state"))
    history = spark.read.parquet(f"{path}/history")
    return rounded(history.select("batch_id", "drift_metric", "drift_detected"))


_KNOWN = "FILTER (event_id % 7 <> 0)"


@query(
    "stream_drift_total",
    f"WITH {EV} SELECT CAST({PARTS - 1} AS BIGINT) AS batch_id, count(*) {_KNOWN} AS rows, count(*) FILTER (event_id % 7 = 0) AS missing, "
    f"round(avg(score) {_KNOWN}, 6) AS mean_score, round(stddev_pop(score) {_KNOWN}, 6) AS std_score, min(score) {_KNOWN} AS min_score, max(score) {_KNOWN} AS max_score, "
    f"round(greatest(abs(avg(score) {_KNOWN} - 0.4) / 0.25, abs(stddev_pop(score) {_KNOWN} - 0.25) / 0.25), 6) AS drift_metric, "
    f"greatest(abs(avg(score) {_KNOWN} - 0.4) / 0.25, abs(stddev_pop(score) {_KNOWN} - 0.25) / 0.25) > 0.1 AS drift_detected FROM ev",
)
def _(spark, sf):
    """Scores that come in parts, some of them NaN: the summary after the last part is that of the whole table."""
    path = new_path(spark, "drift-state")
    spoilt = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("score"))
    stream = _parts(spark, sf).withColumn("score", spoilt)
    sinks.finish(sinks.run_batches(stream, sinks.accumulate_drift(f"{path}/history"), f"{path}/state"))
    history = sinks.drift_history(spark, f"{path}/history", 0.4, 0.25).where("part = 'total'")
    last = history.agg(F.max_by(F.struct("*"), "batch_id").alias("r")).select("r.*")
    return rounded(last.drop("part", "mean_drift", "std_drift"))
