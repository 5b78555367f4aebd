import math
import random

import numpy as np
import pandas as pd
import pytest
from helpers import frame, sample_events
from pyspark.sql import functions as F

from eventlens import Detector, Ensemble, IncidentRules, detect
from eventlens.functions.severity import rule_severity, severity_of
from eventlens.operators import drift, evaluation, forest, postfilter, scaling
from eventlens.session import new_path
from eventlens.sources import stores


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3)), 5.0) for i in range(500)] + [(500, 100.0, 100.0, 100.0, 5.0)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, same double").cache()


@pytest.fixture(scope="module")
def model(points):
    return Detector.fit(points, ["id"])


def test_planted_outlier_and_share(points, model):
    scored = model.predict(points).collect()
    assert all(-1 <= r["score"] <= 0 for r in scored)
    assert min(scored, key=lambda r: r["score"])["id"] == 500
    assert sum(r["prediction"] for r in scored) == pytest.approx(0.1 * len(scored), abs=1)
    assert model.offset == pytest.approx(float(np.percentile([r["score"] for r in scored], 10)))


def test_training_does_not_depend_on_partitions_or_order(points, model):
    again = Detector.fit(points.orderBy(F.desc("id")).repartition(7), ["id"])
    # The scaling's last digits depend on the order of the sums.
    cut, same = ["threshold", "path"], ["tree", "node", "feature", "left", "right"]
    assert again.forest.nodes[same].equals(model.forest.nodes[same])
    assert np.allclose(again.forest.nodes[cut], model.forest.nodes[cut], rtol=1e-9, atol=1e-12)
    assert again.offset == pytest.approx(model.offset)


def test_every_tree_isolates_its_sample(model):
    nodes = model.forest.nodes
    assert nodes["tree"].nunique() == forest.TREES
    assert nodes.groupby("tree")["node"].max().max() <= 2 * forest.SAMPLE
    leaves = nodes["feature"] < 0
    assert (leaves.groupby(nodes["tree"]).sum() == (~leaves).groupby(nodes["tree"]).sum() + 1).all()
    # A constant feature is never chosen.
    assert 3 not in set(nodes["feature"])


def test_scores_equal_a_walk_in_plain_python(points, model):
    nodes = {(int(r.tree), int(r.node)): r for r in model.forest.nodes.itertuples()}
    row = points.where("id = 17").first()
    scaled = [(row[f] - m) / (s or 1) for f, m, s in zip(model.features, model.scaler.means, model.scaler.stds)]
    paths = []
    for tree in range(forest.TREES):
        node = nodes[tree, 0]
        while node.feature >= 0:
            node = nodes[tree, int(node.left if scaled[node.feature] < node.threshold else node.right)]
        paths.append(node.path)
    want = -(2.0 ** (-np.mean(paths) / forest.average_path(256)))
    assert model.predict(points).where("id = 17").first()["score"] == pytest.approx(want)


def walked(forest_, block):
    """Paths of all rows in all trees, from node to node."""
    out = []
    for _, own in forest_.nodes.groupby("tree"):
        nodes = {int(r.node): r for r in own.itertuples()}
        paths = []
        for row in block:
            node = nodes[0]
            while node.feature >= 0:
                node = nodes[int(node.left if row[node.feature] < node.threshold else node.right)]
            paths.append(node.path)
        out.append(paths)
    return np.array(out).T


def test_leaf_masks_equal_the_walk_on_every_row(model):
    trees = [own for _, own in model.forest.nodes.groupby("tree")]
    rng = np.random.default_rng(4)
    block = rng.normal(0, 2, (200, len(model.features)))
    cuts = model.forest.nodes.query("feature >= 0")
    for i, r in enumerate(cuts.sample(100, random_state=1).itertuples()):
        block[i, int(r.feature)] = r.threshold  # rows on a cut
    block[150:160, 1] = np.nan
    block[160] = np.inf
    block[161] = -np.inf
    want = walked(model.forest, block)
    for size in (1, 7, 100):
        groups = [forest.LeafMasks.of(trees[i : i + size], len(model.features)) for i in range(0, len(trees), size)]
        assert np.array_equal(np.hstack([g.path_lengths(block) for g in groups]), want)


def test_trees_without_cuts():
    leaf = pd.DataFrame([[0, 0, -1, 0.0, -1, -1, 3.5]], columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    assert forest.LeafMasks.of([leaf, leaf], 2).path_lengths(np.zeros((3, 2))).tolist() == [[3.5, 3.5]] * 3


def test_pick_counts_are_binomial():
    from math import comb

    for trees, share in ((10, 0.3), (100, 0.01), (100, 1e-9), (3, 1.0)):
        want = np.cumsum([comb(trees, k) * share**k * (1 - share) ** (trees - k) for k in range(trees)])
        assert np.allclose(forest.pick_counts(trees, share), want, rtol=1e-9, atol=1e-15)


def test_few_repeated_keys_are_refused(spark):
    """400 repeats among 1,000 keys, which a check for half the rows would let through."""
    df = spark.range(1000).select((F.col("id") % 600).alias("id"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="not unique"):
        forest.fit_forest(df, ["id"], ["x"], trees=10, sample=64)


def test_picks_are_uniform(spark):
    """Every row is as likely in every tree, however many trees pick it."""
    df = spark.range(2000).select("id", F.col("id").cast("double").alias("x"))
    got = forest.sample_rows(df, ["id"], ["x"], 2000, trees=100, sample=100).groupBy("id").count().toPandas()["count"]
    counts = np.concatenate([got, np.zeros(2000 - len(got))])
    # 100 trees at a chance of 1 in 20: mean 5, variance 4.75.
    assert counts.mean() == pytest.approx(5.0) and counts.var() == pytest.approx(4.75, rel=0.15)


@pytest.mark.parametrize("rows", [40, 639, 640, 1279, 1281, 60000])
def test_each_tree_draws_by_itself_at_every_size(spark, rows):
    df = spark.range(rows).select("id", F.col("id").cast("double").alias("x"))
    got = forest.sample_rows(df, ["id"], ["x"], rows, trees=10, sample=64).collect()
    for tree in range(10):
        own = [r["x"][0] for r in got if r["tree"] == tree]
        assert len(own) == len(set(own)) == min(64, rows)
    # Draws of different trees meet as often as independent ones do.
    expected = rows * (1 - (1 - min(64, rows) / rows) ** 10)
    assert len({r["x"][0] for r in got}) == pytest.approx(expected, rel=0.1)


def test_repeated_keys_are_refused(spark):
    df = spark.range(60000).select(F.lit(1).alias("id"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="not unique"):
        forest.fit_forest(df, ["id"], ["x"], trees=10, sample=64)


def test_errors(spark, points, model):
    with pytest.raises(ValueError, match="features not found"):
        model.predict(points.drop("b"))
    with pytest.raises(ValueError, match="empty"):
        Detector.fit(points.where("false"), ["id"])
    with pytest.raises(FileNotFoundError, match="train the model first"):
        stores.load_model(spark, new_path(spark, "nowhere"))


def test_one_row_scores_half(spark):
    one = spark.createDataFrame([(1, 2.0)], "id bigint, x double")
    assert Detector.fit(one, ["id"]).predict(one).first()["score"] == -0.5


def test_save_and_load(spark, points, model):
    loaded = stores.load_model(spark, stores.save_model(spark, model, new_path(spark, "model")))
    assert loaded.info == model.info and loaded.offset == model.offset
    assert sorted(loaded.predict(points).collect()) == sorted(model.predict(points).collect())


def test_second_training_keeps_the_scaler(points, model):
    shifted = points.withColumn("a", F.col("a") + 50).withColumn("extra", F.lit(1.0))
    again = Detector.fit(shifted, ["id"], scaler=model.scaler)
    assert again.scaler == model.scaler and "extra" not in again.features


def test_serving_form(points, model):
    served = model.predict(points.withColumn("a", F.when(F.col("id") != 3, F.col("a"))), raw=True, fill="mean")
    assert {r["prediction"] for r in served.collect()} == {-1, 1}


def test_drift_and_summary(points, model):
    same = model.drift(model.predict(points)).first()
    assert same["drift_metric"] == pytest.approx(0, abs=1e-9) and same["drift_detected"] is False
    moved = model.drift(model.predict(points.withColumn("a", F.col("a") + 20))).first()
    assert moved["drift_detected"] is True
    row = model.summary(points, {"local_weight": 0.3}).first()
    assert row["model_type"] == "IsolationForest" and row["feature_count"] == 4 and row["is_trained"]
    assert row["ensemble"]["second_weight"] == pytest.approx(0.7)


def test_drift_without_spread_is_null(spark):
    df = spark.createDataFrame([(0.5,), (0.5,)], "score double")
    row = drift.score_drift(drift.score_summary(df), F.lit(0.5), F.lit(0.0)).first()
    assert row["drift_metric"] is None and row["drift_detected"] is None


def test_flow_from_events_to_incidents(spark):
    found = detect(sample_events(spark), rules=IncidentRules(score_threshold=0.5), failed_login="error")
    scopes, events = found.scopes.count(), found.events.count()
    assert scopes > 0 and events == 1000
    total = found.incidents.agg(F.sum("event_count")).first()[0]
    assert total == found.events.where("score > 0.5").count()


def test_flow_with_entities(spark):
    found = detect(sample_events(spark), ["username"], 86400, model=None)
    assert found.scopes.columns[:2] == ["scope", "username"]
    assert found.events.count() == 1000


def test_constant_feature_is_only_shifted(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "x double, k double")
    lazy = [tuple(r) for r in scaling.standardize(df, ["x", "k"]).orderBy("x").collect()]
    fitted = [tuple(r) for r in scaling.Scaler.fit(df, ["x", "k"]).transform(df).orderBy("x").collect()]
    assert lazy == fitted == [(-1.0, 0.0), (1.0, 0.0)]


def test_filling(spark):
    rows = [("a", 1.0, None), ("a", None, None), ("b", float("nan"), None), ("b", 5.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    assert [r["x"] for r in scaling.fill_with_zero(df, ["x"]).collect()] == [1, 0, 0, 5]
    filled = scaling.fill_with_mean(df, ["x", "y"]).collect()
    assert [r["x"] for r in filled] == [1, 3, 3, 5] and {r["y"] for r in filled} == {None}
    grouped = scaling.fill_with_mean(df, ["x"], ["g"]).orderBy("g", "x").collect()
    assert [r["x"] for r in grouped] == [1, 1, 5, 5]


def test_ensemble(spark):
    local = spark.createDataFrame([(1, 1, -0.9), (2, 0, -0.2), (3, 1, -0.9)], "event_id bigint, prediction int, score double")
    second = spark.createDataFrame([(1, 0, 0.3), (2, 1, 0.9), (4, 1, 1.0)], "event_id bigint, prediction int, score double")
    weighted = Ensemble().combine(local, second).orderBy("event_id").collect()
    assert [(r["event_id"], r["prediction"], round(r["score"], 9)) for r in weighted] == [(1, 1, 0.6), (2, 1, 0.55)]
    raw = Ensemble(orientation="raw").combine(local, second).orderBy("event_id").collect()
    assert [r["prediction"] for r in raw] == [0, 0] and raw[0]["score"] == pytest.approx(-0.3)
    # With equal weights both must agree.
    assert [r["prediction"] for r in Ensemble(method="voting").combine(local, second).orderBy("event_id").collect()] == [0, 0]
    blend = Ensemble(method="voting")
    blend.update_weights(0.8)
    assert [r["prediction"] for r in blend.combine(local, second).orderBy("event_id").collect()] == [1, 0]
    with pytest.raises(ValueError, match="between 0 and 1"):
        blend.update_weights(1.1)
    with pytest.raises(ValueError, match="unknown ensemble method"):
        Ensemble(method="median")


def test_severity_bounds(spark):
    scores = [0.95, 0.9, 0.8999, 0.7, 0.5, 0.4999]
    df = spark.createDataFrame([(s,) for s in scores], "confidence double")
    got = [r[0] for r in df.select(severity_of(F.col("confidence"))).collect()]
    assert got == ["high", "high", "medium", "medium", "low", "info"]
    rules = [r["r"] and r["r"]["severity"] for r in df.select(rule_severity().alias("r")).collect()]
    assert rules == ["high", "medium", "medium", "low", None, None]


def test_post_filters(spark):
    rows = [(1, 1, 0.65, "x", None), (2, 1, 0.7, None, {"a": "b"}), (3, 0, 0.99, None, None), (4, 1, 0.9, None, None)]
    df = spark.createDataFrame(rows, "event_id bigint, prediction int, score double, pattern_type string, pattern_details map<string,string>")
    ids = lambda out: sorted(r["event_id"] for r in out.collect())
    assert ids(postfilter.post_filter("anomaly_detection")(df)) == [1, 2, 4]
    assert ids(postfilter.post_filter("behavior_analysis")(df)) == [1, 2, 4]
    threats = postfilter.post_filter("threat_detection")(df).collect()
    assert [(r["event_id"], r["threat_category"], r["severity"]) for r in threats] == [(4, "unknown", "medium")]
    patterns = {r["event_id"]: r for r in postfilter.post_filter("pattern_recognition")(df).collect()}
    assert patterns[1]["pattern_type"] == "x" and patterns[4]["pattern_type"] == "unknown"
    assert patterns[2]["pattern_details"] == {"a": "b"} and patterns[4]["pattern_details"] == {}
    with pytest.raises(ValueError, match="unknown model type"):
        postfilter.post_filter("nope")


def test_zip_is_cut_to_the_shorter_list(spark):
    df = spark.createDataFrame([(1, [1, 0, 1], [0.5, 0.6]), (2, [], [0.1])], "batch_id bigint, predictions array<int>, scores array<double>")
    zipped = postfilter.zip_results(df)
    known = spark.createDataFrame([(1, 0, "login")], "batch_id bigint, index int, event_type string")
    got = postfilter.attach_events(zipped, known).orderBy("index").collect()
    assert [(r["index"], r["prediction"], r["score"], r["event_type"]) for r in got] == [(0, 1, 0.5, "login"), (1, 0, 0.6, None)]


def test_evaluation_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string, p string")
    record = evaluation.evaluate(df, F.col("t"), F.col("p"), "2024-01-01T00:00:00", model_info={"b": 1, "a": None}, seq=4).first()
    want = {}
    for c in "abcd":
        hit = sum(t == p == c for t, p in rows)
        support, predicted = sum(t == c for t, _ in rows), sum(p == c for _, p in rows)
        precision, recall = (hit / predicted if predicted else 0), (hit / support if support else 0)
        f1 = 2 * precision * recall / (precision + recall) if hit else 0
        want[c] = (precision, recall, f1, support)
    for c in "abcd":
        r = record["classification_report"][c]
        assert (r["precision"], r["recall"], r["f1"], r["support"]) == pytest.approx(want[c])
    weighted = [sum(w[i] * w[3] for w in want.values()) / 200 for i in range(3)]
    assert [record["precision"], record["recall"], record["f1"]] == pytest.approx(weighted)
    cells = {(t, p): rows.count((t, p)) for t, p in rows}
    assert [tuple(c) for c in record["confusion_matrix"]] == sorted((*pair, n) for pair, n in cells.items())
    assert (record["seq"], record["timestamp"], record["model_info"]) == (4, "2024-01-01T00:00:00", '{"a": null, "b": 1}')
    grid = evaluation.confusion_matrix(evaluation.label_pairs(df, F.col("t"), F.col("p")), "abcd").collect()
    assert {(r["true"], r["pred"]): r["n"] for r in grid} == {(a, b): cells.get((a, b), 0) for a in "abcd" for b in "abcd"}
    assert record["classification_report"]["accuracy"]["f1"] == pytest.approx(sum(t == p for t, p in rows) / 200)
    assert record["classification_report"]["macro avg"]["recall"] == pytest.approx(sum(w[1] for w in want.values()) / 4)


def test_metric_drift(spark):
    schema = "metric string, value double"
    a = spark.createDataFrame([("precision", 0.9), ("recall", 0.5), ("speed", 1.0)], schema)
    b = spark.createDataFrame([("precision", 0.75), ("recall", 0.55), ("speed", 9.0), ("f1", 1.0)], schema)
    got = drift.metric_drift(a, b)
    assert {r["metric"]: (round(r["drift"], 9), r["exceeds"]) for r in got.collect()} == {"precision": (0.15, True), "recall": (0.05, False)}
    assert drift.drift_detected(got).first()[0] is True
    assert drift.drift_detected(got.where("false")).first()[0] is False


def test_metric_drift_query_compares_lines_below_a_quantity_with_the_rest(spark, tmp_path):
    from __spark_entry__ import queries

    # Predicted: A below 15, N below 30, else R. A quantity of null is on neither side.
    lines = [("A", 1.0), ("N", 10.0), ("N", 20.0), ("N", 24.0), ("N", 25.0), ("R", 40.0), ("R", 50.0), ("A", 45.0), ("R", None)]
    spark.createDataFrame(lines, "l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["metric"]: (r["drift"], r["exceeds"], r["drift_detected"]) for r in queries()["metric_drift"](spark, str(tmp_path)).collect()}
    low, high = (0.5 + 3 * 1) / 4, (0 + 1 + 2 * 2 / 3) / 4
    assert got == {"precision": (pytest.approx(low - high, abs=1e-6), True, True), "recall": (0.0, False, True)}


def test_newest_per_group_and_last(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "m string, timestamp int")
    assert sorted(tuple(r) for r in drift.newest(df, 2, ["m"], tie="m").collect()) == [("a", 3), ("a", 4), ("b", 9)]
    assert [r["timestamp"] for r in drift.newest(df, 2, tie="m").collect()] == [9, 4]
    assert tuple(drift.latest(df, tie="m").first()) == ("b", 9)


def test_many_newest_of_a_hot_group(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("m"), F.col("id").alias("timestamp"))
    got = drift.newest(df.repartition(5), 1500, ["m"], tie="m").groupBy("m").agg(F.count("*"), F.min("timestamp")).collect()
    assert sorted(map(tuple, got)) == [("a", 1500, 1500), ("b", 1500, 3751)]


@pytest.mark.parametrize("keep", [999, 1001])
def test_newest_of_a_whole_table(spark, keep):
    df = spark.range(6000).select(F.lit("a").alias("m"), (F.col("id") % 3000).alias("timestamp"), F.col("id").alias("k"))
    got = [(r["timestamp"], r["k"]) for r in drift.newest(df.repartition(5), keep, tie="k").collect()]
    assert got == sorted(((i % 3000, i) for i in range(6000)), reverse=True)[:keep]


def test_missing_numbers_hold_no_comparison(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1, nan), (2, 1, 0.9), (3, 1, None)], "event_id int, prediction int, score double")
    for kept in (postfilter.anomalies(df), postfilter.threats(df), postfilter.patterns(df)):
        assert [r["event_id"] for r in kept.collect()] == [2]
    second = df.withColumn("score", F.lit(0.9))
    got = {r["event_id"]: r["prediction"] for r in Ensemble(orientation="raw").combine(df, second).collect()}
    assert got == {1: 0, 2: 1, 3: None}
    with pytest.raises(ValueError, match="orientation"):
        Ensemble(orientation="Raw")
    base = spark.createDataFrame([(nan, nan)], "mean_score double, std_score double")
    assert drift.score_drift(base, F.lit(0.5), F.lit(0.1)).first()["drift_detected"] is False


def test_area_ignores_rows_without_label_or_score(spark):
    rows = [(1, 0.9), (0, 0.1), (None, 0.95), (0, float("nan")), (1, None)]
    df = spark.createDataFrame(rows, "t int, s double")
    assert evaluation.roc_auc(df, F.col("t"), F.col("s")).first()["roc_auc"] == 1.0
    with pytest.raises(Exception, match="two classes"):
        evaluation.roc_auc(spark.createDataFrame([(2, 0.9)], "t int, s double"), F.col("t"), F.col("s")).collect()


def test_average_path():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_scores_on_events(spark):
    from eventlens.operators.incidents import attach_scores

    df = frame(spark, [{}, {}, {}])
    scores = spark.createDataFrame([(0, 1, 0.9), (2, 0, 0.1)], "event_id bigint, prediction int, score double")
    assert sorted((r["event_id"], r["score"]) for r in attach_scores(df, scores).collect()) == [(0, 0.9), (2, 0.1)]


def test_scores_on_scopes_with_null_entities(spark):
    from eventlens.operators.incidents import attach_scores

    df = frame(spark, [{"username": "a"}, {}, {"username": "b"}])
    scores = spark.createDataFrame([("a", 1, 0.9), (None, 0, 0.1)], "username string, prediction int, score double")
    assert sorted((r["event_id"], r["score"]) for r in attach_scores(df, scores, ["username"]).collect()) == [(0, 0.9), (1, 0.1)]
