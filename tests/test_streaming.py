from datetime import timedelta

import pytest
from helpers import START, frame
from pyspark.sql import functions as F

from eventlens.operators import drift, features, incidents, ordered
from eventlens.schema import EVENT_SCHEMA
from eventlens.session import new_path
from eventlens.sources.streams import stream_table
from eventlens.streaming import queries, sinks


def parts(spark, batches):
    """One parquet file per batch, read one file at a time; event ids run on."""
    path = new_path(spark, "stream-test")
    at = 0
    for number, rows in enumerate(batches):
        numbered = [{"event_id": at + i, **r} for i, r in enumerate(rows)]
        at += len(rows)
        frame(spark, numbered).coalesce(1).write.mode("append").parquet(f"{path}/{number:03d}")
    return path, stream_table(spark, f"{path}/*", EVENT_SCHEMA, files_per_batch=1)


def minutes(*at, **more):
    return [{"timestamp": 60 * m, **more} for m in at]


def test_late_rows_are_dropped_and_counted(spark):
    _, stream = parts(spark, [minutes(0, 5, 100), minutes(101), minutes(1, 102), minutes(200)])
    out = queries.windowed_features(stream, 600)
    path = new_path(spark, "out")
    query = sinks.run_to_table(out, f"{path}/out", f"{path}/state")
    late = sinks.finish(query)
    got = {r["scope"]: r["events"] for r in spark.read.parquet(f"{path}/out").collect()}
    assert [got[k] for k in sorted(got)] == [2, 3]
    assert late >= 1


def test_late_rows_of_more_batches_than_spark_reports(spark):
    batches = [minutes(0, 5), minutes(1000)] + [minutes(1)] * 25
    _, stream = parts(spark, batches)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "10")
    try:
        path = new_path(spark, "out")
        query = sinks.run_to_table(queries.windowed_features(stream, 600), f"{path}/out", f"{path}/state")
        # The first of them comes before the watermark has moved.
        assert sinks.finish(query) == 24
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)


def test_listener_counts_late_rows_without_anybody_asking(spark):
    batches = [minutes(0, 5), minutes(1000)] + [minutes(1)] * 110
    _, stream = parts(spark, batches)
    with sinks.late_rows(spark) as late:
        path = new_path(spark, "out")
        query = sinks.run_to_table(queries.windowed_features(stream, 600), f"{path}/out", f"{path}/state")
        query.awaitTermination()
        # The first of them comes before the watermark has moved.
        assert late.total(query) == 109


def test_repeats_across_batches(spark):
    same = [{"event_id": 7, "timestamp": 0}]
    _, stream = parts(spark, [same, same, [{"event_id": 8, "timestamp": 1}]])
    got = sinks.collect_table(spark, queries.deduplicated(stream), "dedup")
    assert sorted(r["event_id"] for r in got.collect()) == [7, 8]


def test_transitions_of_windows_that_span_batches(spark):
    types = [minutes(1, event_type="a"), minutes(3, event_type="c"), minutes(2, event_type="b"), minutes(70, event_type="z")]
    _, stream = parts(spark, types)
    path = new_path(spark, "staged")
    columns = ["timestamp", "event_id", "event_type"]
    sinks.finish(sinks.stage_by_window(stream, f"{path}/t", 600, columns, f"{path}/state"))
    staged = spark.read.parquet(f"{path}/t")
    values = {"event": F.col("event_type")}
    got = sinks.closed_transitions(staged, 600, 600, values).collect()
    assert {(r["scope"], r["transition"], r["n"]) for r in got} == {(START, "a->b", 1), (START, "b->c", 1)}
    assert sinks.closed_transitions(staged, 600, 600, values, after="2024-01-01 00:10:00").count() == 0


def test_incidents_equal_batch_on_closed_windows(spark):
    rows = [[{"timestamp": 60 * (3 * b + i), "event_type": "ab"[i % 2]} for i in range(3)] for b in range(8)] + [minutes(500)]
    path, stream = parts(spark, rows)
    score = F.lit(0.95)
    got = sinks.collect_table(spark, queries.stream_incidents(stream.withColumn("score", score)), "incidents").drop("model_info")
    batch = incidents.detect_incidents(spark.read.parquet(f"{path}/*").withColumn("score", score)).drop("model_info")
    closed = batch.where("timestamp < '2024-01-01T08:00:00'")
    columns = batch.columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, closed.collect()))


def test_entropy_on_a_stream(spark):
    _, stream = parts(spark, [minutes(0, 1, command="x"), minutes(2, 3, command="y"), minutes(90, command="z")])
    got = sinks.collect_table(spark, queries.windowed_entropy(stream, "command", 600), "entropy").collect()
    assert [(r["distinct"], r["max_frequency"], r["entropy"]) for r in got] == [(2, 2, 1.0)]


def test_drift_per_batch(spark):
    _, stream = parts(spark, [minutes(0), minutes(1)])
    path = new_path(spark, "drift")
    scored = stream.withColumn("score", F.when(F.col("event_id") == 0, 0.5).otherwise(0.9))
    sinks.finish(sinks.run_batches(scored, sinks.record_drift(f"{path}/h", 0.5, 0.1), f"{path}/state"))
    got = spark.read.parquet(f"{path}/h").orderBy("batch_id").collect()
    assert [(r["batch_id"], round(r["mean_drift"], 6)) for r in got] == [(0, 0.0), (1, 4.0)]


def test_smoothed_entropy_equals_batch_on_closed_windows(spark):
    rows = [[{"timestamp": 60 * (4 * b + i), "command": "abcab"[(b * i) % 5], "username": None if i == 1 else str(b)} for i in range(4)] for b in range(6)]
    path, stream = parts(spark, [*rows, minutes(500)])
    got = sinks.collect_table(spark, queries.windowed_entropies(stream, ["command", "username"], 600), "entropies").collect()
    events = frame(spark, [r for batch in rows for r in batch])
    batch = features.field_features(features.with_scope(events, 600), ["scope"], ["text"])
    want = {(r["scope"], r["feature"]): r["value"] for r in batch.collect()}
    assert len(got) == 2 * 3
    for r in got:
        assert r["entropy_smoothed"] == pytest.approx(want[r["scope"].replace(tzinfo=None), f"{r['field']}_entropy"], abs=1e-12)
        assert r["rows"] >= r["distinct"] * 1 and r["mean_frequency"] == r["rows"] / r["distinct"]


def test_transitions_in_state_equal_batch(spark):
    """Slices, windows and batches all cut between neighbours; some values are missing, some times equal."""
    rows = [{"timestamp": 13 * i - (i % 3 == 2) * 13, "event_type": "abc"[i * i % 3], "command": None if i % 4 == 0 else "xy"[i % 2]} for i in range(120)]
    path, stream = parts(spark, [rows[i : i + 17] for i in range(0, 120, 17)] + [minutes(500)])
    kinds = {"event": "event_type", "command": "command"}
    batch = features.with_scope(spark.read.parquet(f"{path}/*").where("timestamp < '2024-01-01T08:00:00'"), 600)
    want = ordered.transition_counts(batch, ["scope"], ["timestamp", "event_id"], {k: F.col(c) for k, c in kinds.items()})
    want = sorted((str(r["scope"]), r["kind"], r["transition"], r["n"]) for r in want.collect())
    for slice_seconds in (7, 60):
        got = sinks.collect_table(spark, queries.windowed_transitions(stream, kinds, 600, slice_seconds=slice_seconds), "steps")
        assert sorted((str(r["scope"]), r["kind"], r["transition"], r["n"]) for r in got.collect()) == want


def test_drift_over_batches_is_that_of_their_union(spark):
    scores = [[0.5, float("nan"), 0.75], [float("nan")], [None, 0.1], [0.9, 0.9, 0.2, 0.4]]
    flat = [s for part in scores for s in part]
    _, stream = parts(spark, [[{"timestamp": 60 * b} for _ in part] for b, part in enumerate(scores)])
    table = F.array(*[F.lit(s).cast("double") for s in flat])
    path = new_path(spark, "drift")
    scored = stream.withColumn("score", F.get(table, F.col("event_id").cast("int")))
    sinks.finish(sinks.run_batches(scored, sinks.accumulate_drift(f"{path}/h"), f"{path}/state"))
    got = sinks.drift_history(spark, f"{path}/h", 0.5, 0.1)
    known = [s for s in flat if s is not None and s == s]
    last = got.where("part = 'total' and batch_id = 3").first()
    assert (last["rows"], last["missing"]) == (len(known), 3) and last["mean_score"] == pytest.approx(sum(known) / len(known))
    whole = drift.score_summary(spark.createDataFrame([(s,) for s in flat], "score double")).first()
    assert last["std_score"] == pytest.approx(whole["std_score"]) and last["min_score"] == 0.1 and last["max_score"] == 0.9
    own = {r["batch_id"]: r["rows"] for r in got.where("part = 'batch'").collect()}
    assert own == {0: 2, 1: 0, 2: 1, 3: 4}


def test_stream_equals_batch_transitions(spark):
    rows = [{"timestamp": 7 * i, "event_type": "abc"[i % 3]} for i in range(50)]
    df = frame(spark, rows)
    want = ordered.transition_counts(df, [], ["timestamp", "event_id"], {"e": F.col("event_type")})
    assert sum(r["n"] for r in want.collect()) == 49


def batches_of_parts(spark, folder, times, **options):
    """Per micro-batch of the check's stream over events at these seconds: its rows and the files that hold them."""
    from checks import stream_checks

    rows = [(i, None if at is None else START + timedelta(seconds=at), i, "view", 1.0, '{"k": 1}') for i, at in enumerate(times)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")
    stream = stream_checks._parts(spark, folder, **options).withColumn("file", F.input_file_name())
    found = {}

    def count(batch, number):
        found[number] = tuple(batch.agg(F.count("*"), F.count_distinct("file")).first())

    sinks.finish(sinks.run_batches(stream, count, new_path(spark, "parts-state")))
    return [found[i] for i in sorted(found)]


def test_files_of_a_part_grow_with_the_table(spark, tmp_path):
    got = batches_of_parts(spark, str(tmp_path), range(400), file_rows=20)
    assert len(got) == 4 and sum(n for n, _ in got) == 400
    assert [files for _, files in got] == [5] * 4


@pytest.mark.parametrize("times", [[0] * 20 + [7200], [None] * 12 + [0, 4000, 8000], [0, 4000, 8000]], ids=["ties", "nulls", "few"])
def test_a_part_without_rows_takes_no_files_of_the_next(spark, tmp_path, times):
    got = batches_of_parts(spark, str(tmp_path), times)
    assert len(got) == 4 and sum(n for n, _ in got) == len(times)
