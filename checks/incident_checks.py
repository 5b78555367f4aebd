"""Events in and out, incidents, routing, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.sample import EV, events, table
from eventlens import IncidentRules
from eventlens.functions.severity import rule_severity, severity_of
from eventlens.functions.time import parse_time
from eventlens.operators import incidents, registry, routing
from eventlens.schema import EVENT_SCHEMA, JSON_TIME
from eventlens.session import new_path
from eventlens.sources import events as sources, stores

MODEL = {"model_type": "IsolationForest", "model_version": "1.0.0"}
RULES = IncidentRules()

INCIDENTS = f"""{EV},
hit AS (SELECT time_bucket(INTERVAL '300 seconds', timestamp) AS w, * FROM ev WHERE score > 0.8),
ty AS (SELECT w, event_type, count(*) AS n, min((timestamp, event_id)) AS f FROM hit GROUP BY ALL),
de AS (SELECT w, string_agg(concat('- ', n, ' ', event_type, ' events', chr(10)), '' ORDER BY f) AS lines FROM ty GROUP BY w),
gr AS (SELECT w, count(*) AS event_count, max(score) AS max_score FROM hit GROUP BY w),
inc AS (SELECT substr(sha256(concat(strftime(w, '%Y-%m-%dT%H:%M:%S'), '|model_type=IsolationForest|model_version=1.0.0')), 1, 32) AS id,
               concat('Anomaly Detected: ', event_count, ' events') AS title,
               CASE WHEN max_score >= 0.9 THEN 'high' WHEN max_score >= 0.7 THEN 'medium' WHEN max_score >= 0.5 THEN 'low' ELSE 'info' END AS severity,
               strftime(w, '%Y-%m-%dT%H:%M:%S') AS timestamp,
               concat('Detected ', event_count, ' anomalous events:', chr(10), lines) AS description, max_score, event_count
        FROM gr JOIN de USING (w))"""

COLUMNS = ["id", "title", "severity", "timestamp", "description", "max_score", "event_count"]


def _incidents(spark, sf, rules=RULES):
    return incidents.detect_incidents(events(spark, sf), rules, MODEL)


# ---- events ----


@query("events_source", f"WITH {EV} SELECT {', '.join(EVENT_SCHEMA.names)} FROM ev")
def _(spark, sf):
    path = new_path(spark, "events")
    sources.write_events(events(spark, sf).select(*EVENT_SCHEMA.names), path)
    return sources.warn_if_empty(sources.read_events(spark, path))


@query(
    "events_source_json",
    f"WITH {EV} SELECT {', '.join('CAST(NULL AS VARCHAR) AS syscall' if n == 'syscall' else n for n in EVENT_SCHEMA.names)} FROM ev",
)
def _(spark, sf):
    path = new_path(spark, "events")
    sources.write_events(events(spark, sf).select(*[n for n in EVENT_SCHEMA.names if n != "syscall"]), path, "json")
    return sources.read_events(spark, path, "json")


REQUESTED = "2024-02-01 00:00:00"


@query(
    "event_records_json",
    f"WITH {EV} SELECT concat('{{\"event_id\":', event_id, ',\"command\":', CASE WHEN command IS NULL THEN 'null' ELSE concat('\"', command, '\"') END, ',\"timestamp\":\"', "
    f"strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), '\"}}') AS event, TIMESTAMP '{REQUESTED}' AS timestamp, 'hybrid_detector' AS source FROM ev",
)
def _(spark, sf):
    return sources.event_records(events(spark, sf), ["event_id", "command", "timestamp"], REQUESTED)


@query("event_records_roundtrip", f"WITH {EV} SELECT {', '.join(EVENT_SCHEMA.names)} FROM ev")
def _(spark, sf):
    records = sources.event_records(events(spark, sf), EVENT_SCHEMA.names, REQUESTED)
    return records.select(F.from_json("event", EVENT_SCHEMA).alias("e")).select("e.*")


@query("payload_rows", f"WITH {EV} SELECT event_id, execution_time, command FROM ev")
def _(spark, sf):
    fields = ("event_id", "execution_time", "command")
    records = F.to_json(F.array(F.struct(*fields)))
    columns = F.to_json(F.struct(*[F.array(f).alias(f) for f in fields]), {"ignoreNullFields": "false"})
    payload = F.when(F.col("event_id") % 2 == 0, records).otherwise(columns)
    sent = events(spark, sf).select(payload.alias("payload"))
    return sources.payload_rows(sent, F.col("payload"), "event_id bigint, execution_time double, command string")


@query(
    "payload_rejects",
    f"WITH {EV} SELECT event_id, event_id % 5 IN (1, 2, 3) AS rejected FROM ev",
)
def _(spark, sf):
    i = F.col("event_id")
    good = F.concat(F.lit('[{"event_id": '), i, F.lit("}]"))
    uneven = F.concat(F.lit('{"event_id": ['), i, F.lit("], \"command\": []}"))
    cut = F.concat(F.lit('{"event_id": ['), i)
    whole = F.concat(F.lit('{"event_id": ['), i, F.lit("]}"))
    payload = F.when(i % 5 == 0, good).when(i % 5 == 1, uneven).when(i % 5 == 2, cut).when(i % 5 == 4, whole)
    sent = events(spark, sf).select(i.alias("sent"), payload.alias("payload"))
    schema = "event_id bigint, command string"
    rows = sources.payload_rows(sent, F.col("payload"), schema, strict=False).select("event_id", F.lit(False).alias("rejected"))
    return rows.unionByName(sources.payload_rejects(sent, F.col("payload"), schema).select(F.col("sent").alias("event_id"), F.lit(True).alias("rejected")))


@query(
    "time_parse",
    f"WITH {EV} SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN timestamp END AS parsed FROM ev",
)
def _(spark, sf):
    text = F.col("timestamp").cast("string")
    spoilt = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("at "), text)).otherwise(text)
    return events(spark, sf).select("event_id", parse_time(spoilt, strict=False).alias("parsed"))


@query(
    "events_rejected",
    f"WITH {EV} SELECT event_id, event_id % 4 = 1 AS rejected FROM ev",
)
def _(spark, sf):
    path = new_path(spark, "events")
    spoilt = events(spark, sf).withColumn("event_type", F.when(F.col("event_id") % 4 != 1, F.col("event_type")))
    sources.write_events(spoilt.select(*EVENT_SCHEMA.names), path, "json")
    good = sources.read_events(spark, path, "json", strict=False)
    bad = sources.rejected_events(spark, path)
    return good.select("event_id", F.lit(False).alias("rejected")).unionByName(bad.select("event_id", F.lit(True).alias("rejected")))


# ---- incidents ----


@query("severity_bucket", f"WITH {EV} SELECT event_id, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'info' END AS severity FROM ev")
def _(spark, sf):
    return events(spark, sf).select("event_id", severity_of(F.col("score")).alias("severity"))


@query(
    "rule_severity",
    f"WITH {EV} SELECT event_id, CASE WHEN score >= 0.95 THEN 'high_confidence_anomaly' WHEN score >= 0.8 THEN 'medium_confidence_anomaly' ELSE 'low_confidence_anomaly' END AS rule, "
    "CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS severity, score >= 0.95 AS auto_escalate FROM ev WHERE score >= 0.6",
)
def _(spark, sf):
    found = events(spark, sf).withColumnRenamed("score", "confidence").select("event_id", rule_severity().alias("r"))
    return found.where(F.col("r").isNotNull()).select("event_id", "r.*")


@query("scored_events", f"WITH {EV} SELECT event_id, event_type, prediction, score FROM ev WHERE event_id % 4 <> 0")
def _(spark, sf):
    df = events(spark, sf)
    scores = df.where(F.col("event_id") % 4 != 0).select("event_id", "prediction", "score")
    return incidents.attach_scores(df, scores).select("event_id", "event_type", "prediction", "score")


@query("incidents", f"WITH {INCIDENTS} SELECT * FROM inc")
def _(spark, sf):
    return _incidents(spark, sf).select(*COLUMNS)


@query("incident_description", f"WITH {INCIDENTS} SELECT id, description FROM inc")
def _(spark, sf):
    low = IncidentRules.from_config({"incident_window_size": 300})
    return _incidents(spark, sf, low).select("id", "description")


@query(
    "incident_events",
    f"WITH {INCIDENTS} SELECT id AS incident_id, event_id, score FROM hit JOIN inc ON strftime(w, '%Y-%m-%dT%H:%M:%S') = inc.timestamp",
)
def _(spark, sf):
    return incidents.high_score_events(events(spark, sf), RULES, MODEL).select("incident_id", "event_id", "score")


@query(
    "incident_event_store",
    f"WITH {INCIDENTS}, top AS (SELECT id, timestamp AS t FROM inc ORDER BY event_count DESC, timestamp LIMIT 1) "
    "SELECT id AS incident_id, event_id, hit.timestamp, score FROM hit JOIN top ON strftime(w, '%Y-%m-%dT%H:%M:%S') = t",
)
def _(spark, sf):
    path = new_path(spark, "incident-events")
    scored = events(spark, sf)
    stores.write_incident_events(incidents.high_score_events(scored, RULES, MODEL), path)
    top = incidents.detect_incidents(scored, RULES, MODEL).orderBy(F.desc("event_count"), "timestamp").limit(1)
    return stores.read_incident_events(spark, path, top).select("incident_id", "event_id", "timestamp", "score")


@query("incident_store", f"WITH {INCIDENTS} SELECT *, 2 AS model_facts FROM inc")
def _(spark, sf):
    path = new_path(spark, "incidents")
    stores.write_incidents(_incidents(spark, sf), path)
    return stores.read_incidents(spark, path).select(*COLUMNS, F.size("model_info").alias("model_facts"))


@query("incident_lookup", f"WITH {INCIDENTS} SELECT id, title, severity FROM inc ORDER BY event_count DESC, timestamp LIMIT 1")
def _(spark, sf):
    path = new_path(spark, "incidents")
    stores.write_incidents(_incidents(spark, sf), path)
    wanted = stores.read_incidents(spark, path).orderBy(F.desc("event_count"), "timestamp").first()
    return stores.find_incident(spark, path, wanted["id"], wanted["timestamp"][:10]).select("id", "title", "severity")


@query("incident_store_twice", f"WITH {INCIDENTS} SELECT * FROM inc")
def _(spark, sf):
    path = new_path(spark, "incidents")
    # The second write corrects the titles of the first one.
    stores.write_incidents(_incidents(spark, sf).withColumn("title", F.lit("to be replaced")), path)
    stores.write_incidents(_incidents(spark, sf), path)
    return stores.read_incidents(spark, path).select(*COLUMNS)


@query(
    "incident_events_twice",
    f"WITH {INCIDENTS} SELECT id AS incident_id, event_id, score FROM hit JOIN inc ON strftime(w, '%Y-%m-%dT%H:%M:%S') = inc.timestamp",
)
def _(spark, sf):
    path = new_path(spark, "incident-events")
    hits = incidents.high_score_events(events(spark, sf), RULES, MODEL)
    stores.write_incident_events(hits, path)
    stores.write_incident_events(hits, path)
    return stores.read_incident_events(spark, path).select("incident_id", "event_id", "score")


@query(
    "incident_events_in_parts",
    f"WITH {INCIDENTS} SELECT id AS incident_id, event_id, CASE WHEN event_id % 3 = 0 THEN score ELSE score + 1 END AS score "
    "FROM hit JOIN inc ON strftime(w, '%Y-%m-%dT%H:%M:%S') = inc.timestamp",
)
def _(spark, sf):
    """Events of one incident that come in two overlapping writes: all are there, each as last written, also after the writes are made one."""
    path = new_path(spark, "incident-events")
    hits = incidents.high_score_events(events(spark, sf), RULES, MODEL)
    stores.write_incident_events(hits.where("event_id % 2 = 0 or event_id % 3 = 0"), path)
    stores.write_incident_events(hits.where("event_id % 3 <> 0").withColumn("score", F.col("score") + 1), path)
    stores.compact_incident_events(spark, path)
    return stores.read_incident_events(spark, path).select("incident_id", "event_id", "score")


@query(
    "incident_without_time",
    f"WITH {EV}, e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN timestamp END AS timestamp, score FROM ev WHERE score > 0.8) "
    "SELECT event_id, score FROM e WHERE timestamp IS NULL",
)
def _(spark, sf):
    """Hits without a time are one incident; its stored events can be read like any other's."""
    timeless = events(spark, sf).withColumn("timestamp", F.when(F.col("event_id") % 2 == 0, F.col("timestamp")))
    path = new_path(spark, "incident-events")
    stores.write_incident_events(incidents.high_score_events(timeless, RULES, MODEL), path)
    own = incidents.detect_incidents(timeless, RULES, MODEL).where("timestamp is null")
    return stores.read_incident_events(spark, path, own).select("event_id", "score")


_NAN = INCIDENTS.replace("WHERE score > 0.8", "WHERE score > 0.8 AND event_id % 11 <> 0")


@query("nan_incidents", f"WITH {_NAN} SELECT * FROM inc")
def _(spark, sf):
    spoilt = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("score"))
    return incidents.detect_incidents(events(spark, sf).withColumn("score", spoilt), RULES, MODEL).select(*COLUMNS)


@query(
    "incident_list",
    f"WITH {INCIDENTS} SELECT id, severity, timestamp FROM inc WHERE severity = 'high' AND timestamp >= '2024-01-05T00:00:00' AND timestamp <= '2024-01-20T00:00:00'",
)
def _(spark, sf):
    path = new_path(spark, "incidents")
    stores.write_incidents(_incidents(spark, sf), path)
    start, end = "2024-01-05T00:00:00", "2024-01-20T00:00:00"
    days = stores.read_incidents(spark, path, start, end)
    return incidents.list_incidents(days, "high", start, end).select("id", "severity", "timestamp")


@query(
    "incident_scan_tolerant",
    f"WITH {INCIDENTS} SELECT id, severity, event_count, (SELECT count(*) FROM inc WHERE event_count > 1) AS unreadable FROM inc WHERE event_count = 1",
)
def _(spark, sf):
    path = new_path(spark, "incidents")
    lines = _incidents(spark, sf).select("event_count", F.to_json(F.struct("*")).alias("value"))
    # Records of larger incidents are cut in the middle, as after a crash.
    cut = F.when(F.col("event_count") > 1, F.expr("left(value, 60)")).otherwise(F.col("value"))
    lines.select(cut.alias("value")).write.text(f"{path}/lines")
    lines.select("value").write.csv(f"{path}/other")
    usable, unreadable = stores.scan_incident_files(spark, path, "*.txt")
    return usable.select("id", "severity", "event_count", unreadable.agg(F.count("*")).scalar().alias("unreadable"))


@query(
    "alerts_merged",
    f"WITH {INCIDENTS}, al AS (SELECT concat('alert-', event_id) AS id, timestamp, alert_level FROM ev WHERE alert_level >= 12 "
    "UNION ALL SELECT id, CAST(timestamp AS TIMESTAMP), NULL FROM inc) "
    "SELECT * FROM al WHERE timestamp BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 12:00:00'",
)
def _(spark, sf):
    remote = events(spark, sf).where("alert_level >= 12").select(
        F.concat(F.lit("alert-"), "event_id").alias("id"), "timestamp", "alert_level"
    )
    local = _incidents(spark, sf).select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))
    return incidents.merge_alerts(remote, local, "2024-01-03 00:00:00", "2024-01-25 12:00:00")


# ---- routing ----

CHANNELS = ["slack", "webhook"]


@query(
    "incident_routing",
    f"WITH {INCIDENTS} SELECT id, severity, unnest(CASE severity WHEN 'high' THEN ['slack', 'webhook'] WHEN 'medium' THEN ['slack', 'webhook'] "
    "WHEN 'low' THEN ['webhook'] ELSE [] END) AS channel FROM inc",
)
def _(spark, sf):
    # Mail is not configured here, so it drops out of the routes.
    return routing.route(_incidents(spark, sf), CHANNELS).select("id", "severity", "channel")


@query(
    "event_pages",
    f"WITH {INCIDENTS}, nr AS (SELECT id, event_id, (row_number() OVER (PARTITION BY w ORDER BY hit.timestamp, event_id) - 1) // 2 AS page "
    "FROM hit JOIN inc ON strftime(w, '%Y-%m-%dT%H:%M:%S') = inc.timestamp) "
    "SELECT id AS incident_id, page, string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM nr GROUP BY ALL",
)
def _(spark, sf):
    pages = incidents.event_pages(incidents.high_score_events(events(spark, sf), RULES, MODEL), 2)
    # Event ids rise with time in these tables.
    return pages.select("incident_id", "page", F.array_join("events.event_id", ",").alias("event_ids"))


# Events per page: several pages for the larger incidents.
PAGE = 2


def _messages(spark, sf):
    df = events(spark, sf)
    pages = incidents.event_pages(incidents.high_score_events(df, RULES, MODEL), PAGE)
    routed = routing.route(_incidents(spark, sf), ["email", "slack", "webhook"])
    return routing.with_payload(routing.with_event_pages(routed, pages))


# Every event of every message, as read back from the body, with the texts before it.
_SENT = f"""{INCIDENTS},
pg AS (SELECT inc.*, event_id, hit.timestamp AS sent_at, command, (row_number() OVER (PARTITION BY w ORDER BY hit.timestamp, event_id) - 1) // {PAGE} AS page,
              CAST(ceil(event_count / {PAGE}) AS BIGINT) AS pages FROM hit JOIN inc ON strftime(w, '%Y-%m-%dT%H:%M:%S') = inc.timestamp),
nl AS (SELECT id, page, count(*) FILTER (command IS NULL) AS nulls FROM pg GROUP BY ALL)"""
_SENT_COLUMNS = "id, concat('Security Incident Alert: ', title) AS subject, page, pages, event_id, sent_at AS timestamp, command, CAST(nulls AS INTEGER) AS nulls"
_EVENTS = "page bigint, pages bigint, events array<struct<event_id: bigint, timestamp: timestamp_ntz, command: string>>"


def _read_back(messages, head, text):
    read = messages.select("id", "subject", head.alias("head"), text.alias("text"))
    nulls = F.regexp_count("text", F.lit('"command" ?: ?null')).alias("nulls")
    found = read.select("id", "subject", "head", nulls, F.from_json("text", _EVENTS, JSON_TIME).alias("d"))
    return found.select("id", "subject", "head", "nulls", "d.page", "d.pages", F.inline("d.events"))


@query(
    "payload_email",
    f"""WITH {_SENT} SELECT {_SENT_COLUMNS}, concat_ws(chr(10), '<html><body><h2>Security Incident Alert</h2>',
concat('<p><strong>Title:</strong> ', title, '</p>'), concat('<p><strong>Severity:</strong> ', severity, '</p>'),
concat('<p><strong>Timestamp:</strong> ', timestamp, '</p>'), '<p><strong>Description:</strong></p>', concat('<p>', description, '</p>'),
'<p><strong>Details:</strong></p>', '') AS head FROM pg JOIN nl USING (id, page) WHERE severity = 'high'""",
)
def _(spark, sf):
    sent = _messages(spark, sf).where(F.col("channel") == "email")
    text = F.replace(F.regexp_extract("body", "(?s)<pre>(.*)</pre>", 1), F.lit("&quot;"), F.lit('"'))
    return _read_back(sent, F.substring_index("body", "<pre>", 1), text)


@query(
    "payload_slack",
    f"""WITH {_SENT} SELECT {_SENT_COLUMNS}, concat_ws('|', concat('Security Incident Alert: ', title), concat('*Severity:*', chr(10), severity),
concat('*Timestamp:*', chr(10), timestamp), concat('*Description:*', chr(10), description)) AS head FROM pg JOIN nl USING (id, page)""",
)
def _(spark, sf):
    sent = _messages(spark, sf).where(F.col("channel") == "slack")
    blocks = F.from_json("body", "array<struct<text: struct<text: string>, fields: array<struct<text: string>>>>").alias("b")
    read = sent.select("id", "subject", blocks)
    head = F.concat_ws("|", F.expr("b[0].text.text"), F.expr("b[1].fields[0].text"), F.expr("b[1].fields[1].text"), F.expr("b[2].text.text"))
    return _read_back(read, head, F.regexp_extract(F.expr("b[3].text.text"), "(?s)```(.*)```", 1))


@query("payload_webhook", f"WITH {_SENT} SELECT {_SENT_COLUMNS}, concat_ws('|', title, severity, timestamp, description) AS head FROM pg JOIN nl USING (id, page)")
def _(spark, sf):
    sent = _messages(spark, sf).where(F.col("channel") == "webhook")
    head = F.concat_ws("|", *[F.get_json_object("body", f"$.{c}") for c in ("title", "severity", "timestamp", "description")])
    return _read_back(sent, head, F.get_json_object("body", "$.details"))


@query(
    "payload_events",
    f"WITH {INCIDENTS} SELECT id, title, event_id, hit.score FROM hit JOIN inc ON strftime(w, '%Y-%m-%dT%H:%M:%S') = inc.timestamp",
)
def _(spark, sf):
    sent = _messages(spark, sf).where(F.col("channel") == "webhook")
    schema = "id string, title string, details struct<events: array<struct<event_id: bigint, score: double>>>"
    bodies = sent.select(F.from_json("body", schema).alias("b"))
    return bodies.select("b.id", "b.title", F.inline("b.details.events"))


@query(
    "delivery_log",
    f"WITH {INCIDENTS}, r AS (SELECT id, event_count, unnest(CASE severity WHEN 'high' THEN ['email', 'slack', 'webhook'] ELSE ['slack', 'webhook'] END) AS channel FROM inc) "
    "SELECT id AS incident_id, channel, CAST(NULL AS BIGINT) AS page, CASE WHEN event_count > 1 AND channel = 'webhook' THEN 'failed' ELSE 'sent' END AS status, "
    "CASE WHEN event_count > 1 AND channel = 'webhook' THEN 'nothing to send' END AS error FROM r",
)
def _(spark, sf):
    messages = routing.with_payload(routing.route(_incidents(spark, sf), ["email", "slack", "webhook"]))
    empty = (F.col("event_count") > 1) & (F.col("channel") == "webhook")
    return routing.deliver(messages.withColumn("body", F.when(~empty, F.col("body"))))


# ---- records ----

_INFO = "concat('{\"customer\": \"', o_custkey, '\", \"status\": \"', o_orderstatus, '\"}')"
_LOG = f"lg AS (SELECT substr(sha256({_INFO}), 1, 12) AS version_id, o_orderkey, o_custkey, o_orderdate AS timestamp, o_totalprice AS price FROM orders)"


def _models(spark, sf):
    """Model versions: one per customer and order status, written again with every order."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderdate").alias("timestamp"),
        F.create_map(
            F.lit("status"), F.col("o_orderstatus"), F.lit("customer"), F.col("o_custkey").cast("string")
        ).alias("model_info"),
        F.create_map(F.lit("price"), F.col("o_totalprice")).alias("metrics"),
        F.concat(F.lit("/models/"), "o_orderkey").alias("model_path"),
    )


def _log(spark, sf):
    models = _models(spark, sf)
    return models.withColumn("version_id", registry.content_id(F.col("model_info")))


@query("content_id", f"WITH {_LOG} SELECT version_id, price, timestamp, concat('/models/', o_orderkey) AS model_path FROM lg")
def _(spark, sf):
    records = registry.version_records(_models(spark, sf))
    return records.select("version_id", F.col("metrics")["price"].alias("price"), "timestamp", "model_path")


_LATEST = f"{_LOG}, la AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY timestamp DESC, o_orderkey DESC) = 1)"


@query("registry_latest", f"WITH {_LATEST} SELECT version_id, timestamp, price FROM la")
def _(spark, sf):
    latest = registry.latest_records(_log(spark, sf), "version_id", tie="o_orderkey")
    return latest.select("version_id", "timestamp", F.col("metrics")["price"].alias("price"))


@query("registry_lookup", f"WITH {_LATEST} SELECT version_id, timestamp, price FROM la WHERE version_id = (SELECT min(version_id) FROM la)")
def _(spark, sf):
    latest = registry.latest_records(_log(spark, sf), "version_id", tie="o_orderkey")
    first = latest.agg(F.min("version_id")).first()[0]
    found = registry.lookup(latest, "version_id", first)
    return found.select("version_id", "timestamp", F.col("metrics")["price"].alias("price"))


@query("registry_list", f"WITH {_LATEST} SELECT version_id, timestamp FROM la WHERE price >= 100000")
def _(spark, sf):
    latest = registry.latest_records(_log(spark, sf), "version_id", tie="o_orderkey")
    return registry.list_records(latest, "version_id", F.col("metrics")["price"] >= 100000).select("version_id", "timestamp")


@query(
    "registry_retention",
    f"WITH {_LOG} SELECT o_custkey, o_orderkey, version_id FROM lg QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY timestamp DESC, o_orderkey DESC) <= 5",
)
def _(spark, sf):
    return registry.keep_newest(_log(spark, sf), "o_custkey", 5, tie="o_orderkey").select("o_custkey", "o_orderkey", "version_id")


_EXPERIMENTS = (
    "ex AS (SELECT c_custkey, substr(sha256(concat(c_name, '_{\"nation\": \"', c_nationkey, '\", \"segment\": \"', c_mktsegment, '\"}')), 1, 12) "
    "AS experiment_id, c_name AS name FROM customer)"
)


def _experiments(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.lit("orders of one customer").alias("description"),
        F.create_map(
            F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")
        ).alias("parameters"),
        F.current_timestamp().alias("timestamp"),
    )
    links = _log(spark, sf).join(
        customers.select(F.col("c_custkey").alias("o_custkey"), registry.experiment_content_id(F.col("name"), F.col("parameters")).alias("experiment_id")),
        "o_custkey",
    )
    return registry.experiment_records(customers), links.select("experiment_id", "version_id", "o_orderkey")


_LINKS = f"{_LOG}, {_EXPERIMENTS}, li AS (SELECT experiment_id, version_id, o_orderkey % 2 AS fresh FROM ex JOIN lg ON o_custkey = c_custkey)"


def _half(links, rest):
    return links.where(F.col("o_orderkey") % 2 == rest)


@query("experiment_versions", f"WITH {_LINKS} SELECT DISTINCT experiment_id, version_id FROM li")
def _(spark, sf):
    experiments, links = _experiments(spark, sf)
    return registry.add_versions(_half(links, 0), _half(links, 1), experiments)


@query(
    "experiment_new_links",
    f"WITH {_LINKS} SELECT experiment_id, version_id FROM li GROUP BY ALL HAVING min(fresh) = 1",
)
def _(spark, sf):
    _, links = _experiments(spark, sf)
    return registry.new_links(_half(links, 0), _half(links, 1))


@query(
    "experiment_list",
    f"WITH {_LINKS} SELECT experiment_id, name, 'created' AS status, count(DISTINCT version_id) AS versions FROM ex LEFT JOIN li USING (experiment_id) GROUP BY ALL",
)
def _(spark, sf):
    experiments, links = _experiments(spark, sf)
    counted = registry.experiments_with_counts(experiments, links.select("experiment_id", "version_id").distinct())
    return registry.list_records(counted, "experiment_id").select("experiment_id", "name", "status", "versions")


# ---- metrics history ----

_HISTORY = f"""{EV}, hi AS (SELECT date_trunc('day', timestamp) AS d, round(avg(prediction), 6) AS precision, round(avg(second_prediction), 6) AS recall,
round(avg(score), 6) AS f1, count(*) FILTER (prediction = 1) AS a, count(*) FILTER (prediction = 0) AS b FROM ev GROUP BY 1)"""


@query(
    "metrics_csv_roundtrip",
    f"WITH {_HISTORY} SELECT row_number() OVER (ORDER BY d) - 1 AS seq, strftime(d, '%Y-%m-%dT%H:%M:%S') AS timestamp, precision, recall, f1, "
    "CASE WHEN day(d) % 2 = 0 THEN f1 END AS roc_auc, concat('[[', a, ',0],[0,', b, ']]') AS confusion_matrix, CAST(NULL AS VARCHAR) AS model_info, d = max(d) OVER () AS is_current FROM hi",
)
def _(spark, sf):
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    daily = events(spark, sf).groupBy(day.alias("d")).agg(
        F.round(F.avg("prediction"), 6).alias("precision"),
        F.round(F.avg("second_prediction"), 6).alias("recall"),
        F.round(F.avg("score"), 6).alias("f1"),
        F.count_if(F.col("prediction") == 1).alias("a"),
        F.count_if(F.col("prediction") == 0).alias("b"),
    )
    none = F.lit(0).cast("bigint")
    history = daily.select(
        F.date_diff("d", F.lit("2024-01-01").cast("date")).cast("bigint").alias("seq"),
        F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "precision",
        "recall",
        "f1",
        F.when(F.dayofmonth("d") % 2 == 0, F.col("f1")).alias("roc_auc"),
        F.array(F.array("a", none), F.array(none, F.col("b"))).alias("confusion_matrix"),
        F.create_map(F.lit("a,\"b\""), F.struct("precision", "recall")).alias("classification_report"),
    )
    stored = stores.read_metrics(spark, stores.write_metrics(history, new_path(spark, "metrics")))
    current = stores.current_metrics(stored).select("seq").scalar()
    return stored.drop("classification_report").withColumn("is_current", F.col("seq") == current)


# Information of several types: its text is what Python's JSON writer gives for it.
_TYPED = (
    "concat('{\"items\": [', o_orderkey, ', null], \"model\": {\"open\": ', CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END, "
    "', \"rate\": 1.5e-05}, \"name\": \"', o_orderpriority, '\", \"price\": ', CAST(o_totalprice AS VARCHAR), '}')"
)


@query("content_id_typed", f"SELECT o_orderkey, substr(sha256({_TYPED}), 1, 12) AS version_id FROM orders")
def _(spark, sf):
    none = F.lit(None).cast("bigint")
    info = F.struct(
        F.col("o_totalprice").cast("double").alias("price"),
        F.col("o_orderpriority").alias("name"),
        F.struct(F.lit(1.5e-05).alias("rate"), (F.col("o_orderstatus") == "O").alias("open")).alias("model"),
        F.array(F.col("o_orderkey").cast("bigint"), none).alias("items"),
    )
    models = table(spark, sf, "orders").select(
        "o_orderkey", F.lit(0).alias("timestamp"), info.alias("model_info"), F.lit(None).cast("map<string,double>").alias("metrics"), F.col("o_orderkey").alias("model_path")
    )
    return registry.version_records(models).select(F.col("model_path").alias("o_orderkey"), "version_id")
