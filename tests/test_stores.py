import shutil
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventlens.functions import moments
from eventlens.operators import forest
from eventlens.operators.detector import Detector
from eventlens.session import new_path
from eventlens.sources import commits, stores

HITS = "incident_id string, event_id bigint, window timestamp, score double"


def hits(spark, *rows):
    return spark.createDataFrame(rows, "incident_id string, event_id bigint, at string, score double").select(
        "incident_id", "event_id", F.to_timestamp("at").alias("window"), "score"
    )


def scores(df):
    return sorted((r["incident_id"], r["event_id"], r["score"]) for r in df.collect())


DAY = "2024-01-01 00:00:00"


def test_parts_of_an_incident_add_up_and_replace_by_event(spark):
    path = new_path(spark, "events")
    stores.write_incident_events(hits(spark, ("a", 1, DAY, 0.1), ("a", 2, DAY, 0.2), ("b", 3, DAY, 0.3)), path)
    stores.write_incident_events(hits(spark, ("a", 2, DAY, 0.9), ("a", 4, DAY, 0.4)), path)
    want = [("a", 1, 0.1), ("a", 2, 0.9), ("a", 4, 0.4), ("b", 3, 0.3)]
    assert scores(stores.read_incident_events(spark, path)) == want
    stores.compact_incident_events(spark, path)
    assert len(commits.live_parts(spark, path)) == 1
    assert scores(stores.read_incident_events(spark, path)) == want
    assert commits.vacuum(spark, path) == 2 and scores(stores.read_incident_events(spark, path)) == want
    stores.write_incident_events(hits(spark, ("c", 5, DAY, 0.5)), path, mode="overwrite")
    assert scores(stores.read_incident_events(spark, path)) == [("c", 5, 0.5)]
    with pytest.raises(ValueError, match="append or overwrite"):
        stores.write_incident_events(hits(spark), path, mode="ignore")


def test_events_without_id_or_time_are_kept(spark):
    path = new_path(spark, "events")
    stores.write_incident_events(hits(spark, ("a", None, None, 0.1), ("a", None, None, 0.2)), path)
    stores.write_incident_events(hits(spark, ("a", None, None, 0.3), ("z", 1, DAY, 0.5)), path)
    one = spark.createDataFrame([("a", None)], "id string, timestamp string")
    assert sorted(r["score"] for r in stores.read_incident_events(spark, path, one).collect()) == [0.1, 0.2, 0.3]


def test_a_write_that_broke_off_is_invisible(spark):
    path = new_path(spark, "events")
    stores.write_incident_events(hits(spark, ("a", 1, DAY, 0.1)), path)
    # What a writer leaves that dies before its commit.
    hits(spark, ("a", 1, DAY, 0.7), ("q", 9, DAY, 0.7)).withColumn("dt", F.lit("2024-01-01")).write.partitionBy("dt").parquet(
        commits.part_path(path, commits.new_part())
    )
    assert scores(stores.read_incident_events(spark, path)) == [("a", 1, 0.1)]
    assert commits.vacuum(spark, path) == 1


@pytest.fixture(scope="module")
def models(spark):
    points = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    return [Detector.fit(points, ["id"], trees=10, sample=64, seed=s) for s in (1, 2)]


def test_a_model_is_old_or_new_but_never_mixed(spark, models):
    old, new = models
    path = stores.save_model(spark, old, new_path(spark, "model"))
    # A second save that dies after two of its three tables.
    torn = commits.part_path(path, commits.new_part())
    spark.createDataFrame(new.forest.nodes, forest.NODE_SCHEMA).write.parquet(f"{torn}/nodes")
    assert stores.load_model(spark, path).forest.nodes.equals(old.forest.nodes)
    stores.save_model(spark, new, path)
    assert stores.load_model(spark, path).forest.nodes.equals(new.forest.nodes)
    shutil.rmtree(Path(commits.part_path(path, commits.live_parts(spark, path)[-1]).removeprefix("file:")) / "info")
    with pytest.raises(FileNotFoundError, match="info"):
        stores.load_model(spark, path)


def test_readers_during_a_save_get_whole_models(spark, models):
    path = stores.save_model(spark, models[0], new_path(spark, "model"))
    known = [m.forest.nodes for m in models]
    writer = threading.Thread(target=lambda: stores.save_model(spark, models[1], path))
    writer.start()
    while writer.is_alive():
        loaded = stores.load_model(spark, path).forest.nodes
        assert any(loaded.equals(k) for k in known)
    writer.join()
    assert stores.load_model(spark, path).forest.nodes.equals(known[1])


def test_summaries_merge_to_the_summary_of_all_rows(spark):
    values = [1e9 + x for x in (0.25, 0.5, 4.0, -3.0)] + [None, float("nan"), 1e9]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(7, None)], "part int, v double")
    parts = df.groupBy("part").agg(moments.moments(F.col("v")).alias("m"))
    merged = parts.agg(moments.merged_all(F.collect_list("m")).alias("m")).select("m.*", moments.deviation(F.col("m")).alias("sd")).first()
    whole = df.agg(moments.moments(F.col("v")).alias("m")).select("m.*", moments.deviation(F.col("m")).alias("sd")).first()
    assert merged["n"] == whole["n"] == 5 and merged["missing"] == whole["missing"] == 3
    for name in ("mean", "m2", "lo", "hi", "sd"):
        assert merged[name] == pytest.approx(whole[name], rel=1e-7)
    none = spark.range(1).select(moments.merged(moments.nothing(), moments.nothing()).alias("m")).select("m.*").first()
    assert none["n"] == 0 and none["mean"] is None
