import hashlib
import json
from datetime import datetime

import pytest
from helpers import frame
from pyspark.sql import functions as F

from eventlens import IncidentRules
from eventlens.config import enabled_channels
from eventlens.functions import render
from eventlens.functions.ids import content_id, experiment_content_id
from eventlens.operators import incidents, registry, routing
from eventlens.session import new_path
from eventlens.sources import events as sources, stores


def scored(spark, rows):
    df = frame(spark, [{k: v for k, v in r.items() if k != "score"} for r in rows])
    pairs = spark.createDataFrame([(i, 1, r["score"]) for i, r in enumerate(rows)], "event_id bigint, prediction int, score double")
    return incidents.attach_scores(df, pairs)


@pytest.fixture
def sample(spark):
    rows = [
        {"timestamp": 10, "event_type": "b", "score": 0.85},
        {"timestamp": 20, "event_type": "a", "score": 0.95},
        {"timestamp": 30, "event_type": "b", "score": 0.81},
        {"timestamp": 40, "event_type": "c", "score": 0.8},
        {"timestamp": 300, "event_type": None, "score": 0.82},
        {"timestamp": 900, "event_type": "a", "score": 0.5},
    ]
    return scored(spark, rows)


def test_incidents(sample):
    got = incidents.detect_incidents(sample, model_info={"v": "1"}).orderBy("timestamp").collect()
    assert [(r["title"], r["severity"], r["timestamp"], r["event_count"], r["max_score"]) for r in got] == [
        ("Anomaly Detected: 3 events", "high", "2024-01-01T00:00:00", 3, 0.95),
        ("Anomaly Detected: 1 events", "medium", "2024-01-01T00:05:00", 1, 0.82),
    ]
    # The threshold is strict; types stand in order of first appearance.
    assert got[0]["description"] == "Detected 3 anomalous events:\n- 2 b events\n- 1 a events\n"
    assert got[1]["description"] == "Detected 1 anomalous events:\n- 1 None events\n"
    assert got[0]["model_info"] == {"v": "1"}


def test_ids_do_not_change(sample):
    first = {r["id"] for r in incidents.detect_incidents(sample).collect()}
    assert first == {r["id"] for r in incidents.detect_incidents(sample.repartition(5)).collect()}
    other = {r["id"] for r in incidents.detect_incidents(sample, model_info={"v": "2"}).collect()}
    assert len(first) == 2 and not first & other


def test_events_without_type(sample):
    rows = incidents.detect_incidents(sample.drop("event_type")).orderBy("timestamp").collect()
    assert rows[0]["description"] == "Detected 3 anomalous events:\n- 3 unknown events\n"


def test_rules_from_config():
    rules = IncidentRules.from_config(
        {
            "incident_window_size": 60,
            "incident_rules": {
                "anomaly_score_threshold": 0.4,
                "severity_levels": {"high": 0.8, "medium": 0.6, "low": 0.4},
                "notification_channels": {"high": ["email"]},
            },
        }
    )
    assert (rules.score_threshold, rules.window_seconds, rules.channels) == (0.4, 60, {"high": ["email"]})
    assert IncidentRules.from_config({}) == IncidentRules()


def test_store_lookup_and_list(spark, sample):
    path = new_path(spark, "incidents")
    made = incidents.detect_incidents(sample)
    stores.write_incidents(made, path)
    rows = made.collect()
    for r in rows:
        assert stores.find_incident(spark, path, r["id"]).first()["title"] == r["title"]
    with pytest.raises(ValueError, match="not found"):
        stores.find_incident(spark, path, "missing")
    stored = stores.read_incidents(spark, path)
    assert [r["timestamp"] for r in incidents.list_incidents(stored).collect()] == ["2024-01-01T00:05:00", "2024-01-01T00:00:00"]
    at = "2024-01-01T00:05:00"
    assert incidents.list_incidents(stored, start=at, end=at).count() == 1
    assert incidents.list_incidents(stored, "high", at).count() == 0
    assert stores.read_incidents(spark, path, "2024-01-02T00:00:00").count() == 0


def test_stored_events_of_an_incident(spark, sample):
    path = new_path(spark, "incident-events")
    stores.write_incident_events(incidents.high_score_events(sample), path)
    made = incidents.detect_incidents(sample)
    for r in made.collect():
        found = stores.read_incident_events(spark, path, made.where(F.col("id") == r["id"]))
        assert found.count() == r["event_count"] and found.agg(F.max("score")).first()[0] == r["max_score"]
    assert stores.read_incident_events(spark, path).count() == 4


def test_store_reads_only_the_wanted_days(spark, sample):
    path = new_path(spark, "incidents")
    stores.write_incidents(incidents.detect_incidents(sample), path)
    df = stores.read_incidents(spark, path, "2024-01-01T00:00:00", "2024-01-01T12:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(timestamp" in plan


def test_tolerant_scan(spark, sample, tmp_path):
    good = [r["j"] for r in incidents.detect_incidents(sample).select(F.to_json(F.struct("*")).alias("j")).collect()]
    (tmp_path / "a.json").write_text(good[0] + "\n" + good[1][:40] + "\n")
    (tmp_path / "b.json").write_text("not json\n{}\n")
    (tmp_path / "c.tmp").write_text(good[1] + "\n")
    usable, broken = stores.scan_incident_files(spark, str(tmp_path))
    assert usable.count() == 1 and broken.count() == 3


def test_routes(spark, sample):
    made = incidents.detect_incidents(sample)
    routes = {(r["severity"], r["channel"]) for r in routing.route(made, ["email", "slack", "webhook"]).collect()}
    assert routes == {("high", "email"), ("high", "slack"), ("high", "webhook"), ("medium", "slack"), ("medium", "webhook")}
    assert {r["channel"] for r in routing.route(made, ["webhook"]).collect()} == {"webhook"}
    assert routing.route(made, ["email", "slack"], None).count() == 4
    info = made.withColumn("severity", F.lit("info"))
    assert routing.route(info, ["email", "slack", "webhook"]).count() == 0
    config = {"notifications": {"email": {}, "slack": {"enabled": False}, "webhook": {"enabled": True}}}
    assert enabled_channels(config) == ["email", "webhook"] and enabled_channels(None) == []


def test_messages_carry_all_events(spark, sample):
    made = incidents.detect_incidents(sample, model_info={"v": "1"})
    pages = incidents.event_pages(incidents.high_score_events(sample, model_info={"v": "1"}), 2)
    routed = routing.route(made, ["email", "slack", "webhook"])
    rows = routing.with_payload(routing.with_event_pages(routed, pages)).collect()
    assert {r["subject"] for r in rows} == {"Security Incident Alert: Anomaly Detected: 3 events", "Security Incident Alert: Anomaly Detected: 1 events"}
    sent = [json.loads(r["body"]) for r in rows if r["channel"] == "webhook"]
    ids = sorted(e["event_id"] for b in sent for e in b["details"]["events"])
    assert ids == [0, 1, 2, 4] and sent[0]["details"]["model_info"] == {"v": "1"}
    blocks = json.loads(next(r["body"] for r in rows if r["channel"] == "slack" and r["severity"] == "high"))
    assert [b["type"] for b in blocks] == ["header", "section", "section", "section"]
    assert blocks[1]["fields"][0] == {"type": "mrkdwn", "text": "*Severity:*\nhigh"}
    assert "text" not in blocks[1] and blocks[0]["text"]["type"] == "plain_text"
    html = next(r["body"] for r in rows if r["channel"] == "email")
    assert "<strong>Severity:</strong> high" in html and "&quot;event_count&quot; : 3" in html
    pages_of = {(b["id"], b["details"]["page"], b["details"]["pages"]) for b in sent}
    assert len(pages_of) == len(sent) == 3 and {p for _, p, n in pages_of if n == 2} == {0, 1}
    log = routing.deliver(routing.with_payload(routing.with_event_pages(routed, pages))).collect()
    assert {(r["incident_id"], r["page"]) for r in log} == {(i, p) for i, p, _ in pages_of} and {r["status"] for r in log} == {"sent"}
    assert '"username":null' in next(r["body"] for r in rows if r["channel"] == "webhook")


def test_message_defaults(spark):
    empty = spark.createDataFrame(
        [("i", None, None, None, None, None, 1, "email")],
        "id string, title string, severity string, timestamp string, description string, max_score double, event_count bigint, channel string",
    )
    row = routing.with_payload(empty).first()
    assert row["subject"].endswith("Unknown") and "No description available" in row["body"]


def test_delivery_log(spark):
    messages = spark.createDataFrame([("1", "email", "x"), ("2", "slack", "boom"), ("3", "slack", "x")], "id string, channel string, body string")

    def send(incident_id, channel, page, body):
        if body == "boom":
            raise RuntimeError("no route")

    got = {r["incident_id"]: (r["status"], r["error"]) for r in routing.deliver(messages, send).collect()}
    assert got == {"1": ("sent", None), "2": ("failed", "no route"), "3": ("sent", None)}


def test_alerts(spark):
    a = spark.createDataFrame([("x", datetime(2024, 1, 1), 5), ("x", datetime(2024, 1, 1), 5)], "id string, timestamp timestamp_ntz, level int")
    b = spark.createDataFrame([("y", datetime(2024, 1, 2))], "id string, timestamp timestamp_ntz")
    assert [r["id"] for r in incidents.merge_alerts(a, b).collect()] == ["y", "x", "x"]
    assert incidents.merge_alerts(a, b, end="2024-01-01 00:00:00").count() == 2
    assert incidents.merge_alerts(a, b, start="2024-01-01 00:00:01").count() == 1


def test_content_ids_equal_json_and_sha256(spark):
    infos = [
        {"b": "1", "a": "two"},
        {"é": "naïve ß", "q": 'say "hi"\\\n\t\x01\x7f', "emoji": "😀", "empty": ""},
        {"k": None},
        {},
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(infos)], "i int, m map<string,string>")
    got = df.select("i", content_id(F.col("m")).alias("v"), experiment_content_id(F.lit("exp"), F.col("m")).alias("e")).collect()
    for r in got:
        text = json.dumps(infos[r["i"]], sort_keys=True)
        assert r["v"] == hashlib.sha256(text.encode()).hexdigest()[:12]
        assert r["e"] == hashlib.sha256(f"exp_{text}".encode()).hexdigest()[:12]


def test_registry(spark):
    log = spark.createDataFrame([("a", 1, "m1"), ("a", 3, "m1"), ("b", 2, "m1"), ("c", 5, "m2"), ("a", 2, "m1")], "id string, timestamp int, model string")
    latest = registry.latest_records(log, "id", tie="model")
    assert [tuple(r)[:2] for r in registry.list_records(latest, "id").collect()] == [("c", 5), ("a", 3), ("b", 2)]
    assert [r["id"] for r in registry.list_records(latest, "id", F.col("id") != "a").collect()] == ["c", "b"]
    assert registry.lookup(latest, "id", "b").first()["timestamp"] == 2
    with pytest.raises(ValueError, match="not found"):
        registry.lookup(latest, "id", "z")
    kept = registry.keep_newest(log.where("model = 'm1'"), "model", 2, tie="id")
    assert sorted((r["id"], r["timestamp"]) for r in kept.collect()) == [("a", 3), ("b", 2)]


def test_experiment_versions(spark):
    made = spark.createDataFrame([("n", "d", {"p": "1"}, 1)], "name string, description string, parameters map<string,string>, timestamp int")
    experiments = registry.experiment_records(made)
    eid = experiments.first()["experiment_id"]
    links = spark.createDataFrame([(eid, "v1")], "experiment_id string, version_id string")
    added = spark.createDataFrame([(eid, "v1"), (eid, "v2"), (eid, "v2")], "experiment_id string, version_id string")
    assert sorted(r["version_id"] for r in registry.add_versions(links, added, experiments).collect()) == ["v1", "v2"]
    assert [r["version_id"] for r in registry.new_links(links, added).collect()] == ["v2"]
    assert registry.experiments_with_counts(experiments, links).first()["versions"] == 1
    with pytest.raises(ValueError, match="missing not found"):
        registry.add_versions(links, spark.createDataFrame([("missing", "v")], links.schema), experiments)


def test_event_files(spark, tmp_path):
    df = frame(spark, [{"command": "ls"}, {}])
    for fmt in ("parquet", "json"):
        sources.write_events(df, str(tmp_path / fmt), fmt)
        assert sorted(sources.read_events(spark, str(tmp_path / fmt), fmt).collect()) == sorted(df.collect())
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"timestamp": "soon", "event_type": "a"}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        sources.read_events(spark, str(tmp_path / "bad"), "json").collect()
    assert sources.read_events(spark, str(tmp_path / "bad"), "json", strict=False).first() is None
    assert sources.rejected_events(spark, str(tmp_path / "bad")).first()["line"].startswith('{"timestamp": "soon"')
    spark.createDataFrame([("x",)], "invalid string").write.parquet(str(tmp_path / "invalid"))
    with pytest.raises(ValueError, match="timestamp, event_type"):
        sources.read_events(spark, str(tmp_path / "invalid"))


def test_empty_batch_warns(spark, caplog):
    sources.warn_if_empty(frame(spark, [{}]).where("false"))
    assert "no events to process" in caplog.text


def test_payloads(spark):
    texts = ['[{"a": 1, "b": "x"}, {"a": 2}]', '{"a": [3, 4], "b": ["y", null]}']
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    assert sorted((r["a"], r["b"]) for r in sources.payload_rows(df, F.col("p"), "a int, b string").collect()) == [(1, "x"), (2, None), (3, "y"), (4, None)]


def test_unusable_payloads(spark):
    texts = ['[{"a": 1', '{"a": [3, 4], "b": ["y"]}', None, '{"a": [5]}', "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    assert [tuple(r) for r in sources.payload_rows(df, F.col("p"), "a int, b string", strict=False).collect()] == [(5, None)]
    assert [r["p"] for r in sources.payload_rejects(df, F.col("p"), "a int, b string").collect()] == texts[:3]
    for text in texts[:3]:
        with pytest.raises(Exception, match="unusable payload"):
            sources.payload_rows(df.where(F.col("p").eqNullSafe(F.lit(text))), F.col("p"), "a int, b string").collect()


def test_events_without_time_or_type(spark, tmp_path):
    lines = ['{"invalid": "data"}', '{"timestamp": "2024-01-01T00:00:00.5", "event_type": "login", "event_id": 3}', '{"timestamp": "soon"', "{}"]
    (tmp_path / "events.json").write_text("\n".join(lines))
    good = sources.read_events(spark, str(tmp_path), "json", strict=False).collect()
    assert [(r["event_id"], r["event_type"], r["timestamp"]) for r in good] == [(3, "login", datetime(2024, 1, 1, 0, 0, 0, 500000))]
    assert sources.rejected_events(spark, str(tmp_path)).count() == 3
    for bad in (lines[0], lines[2]):
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one" / "events.json").write_text(bad)
        with pytest.raises(Exception):
            sources.read_events(spark, str(tmp_path / "one"), "json").collect()


def test_typed_content_ids(spark):
    rows = [(1, True, [1, 2], {"x": 0.1, "y": 1e-05}, 1e16), (-7, None, [], {}, 123456789.25), (None, False, None, {"z": 1e22, "a": 0.0001}, 5e-300),
            (0, True, [3], {"q": 1.0, "r": -2.5e-7}, 1e15)]
    kind = "struct<n: bigint, b: boolean, l: array<int>, m: map<string,double>, d: double>"
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, s {kind}")
    for r in df.select("i", content_id(F.col("s"), df.schema["s"].dataType).alias("v")).collect():
        text = json.dumps(dict(zip("nblmd", rows[r["i"]], strict=True)), sort_keys=True)
        assert r["v"] == hashlib.sha256(text.encode()).hexdigest()[:12], text


def test_html_shows_texts_as_they_are(spark):
    df = spark.createDataFrame([("<script>'a' & \"b\"</script>",)], "t string")
    body = df.select(render.email_body(F.col("t"), F.col("t"), F.col("t"), F.col("t"), F.struct("t"))).first()[0]
    assert "<script>" not in body and body.count("&lt;script&gt;&#x27;a&#x27; &amp; ") == 5


def test_records_of_events(spark):
    row = sources.event_records(frame(spark, [{"command": "ls"}]), ["event_id", "command", "username"], "2024-01-01 00:00:00").first()
    assert json.loads(row["event"]) == {"event_id": 0, "command": "ls", "username": None} and row["source"] == "hybrid_detector"


def test_content_ids_of_small_and_large_doubles(spark):
    values = [0.00012345678901234567, 0.0001, 0.00099999, -0.0005, 1e-4 / 3, 9.999e-5, 1e7, 123456789012345.6, -98765432.1, 1e15, 9007199254740993.0, 1.5e16, 0.001, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "d double").select("d", F.struct("d").alias("s"))
    for r in df.select("d", content_id(F.col("s"), df.schema["s"].dataType).alias("v")).collect():
        text = json.dumps({"d": r["d"]})
        assert r["v"] == hashlib.sha256(text.encode()).hexdigest()[:12], text
