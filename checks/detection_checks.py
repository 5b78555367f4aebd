"""Matrices, scaling, forest, blending, drift and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from checks.feature_checks import ALL_PARTS, BY
from checks.registry import query, rounded
from checks.sample import EV, FAILED_LOGIN, SC, events, scoped, table
from eventlens import Detector, Ensemble
from eventlens.operators import drift, evaluation, forest, postfilter, scaling
from eventlens.operators.ordered import exact_quantile
from eventlens.plans.detection import MODEL_FEATURES, basic_matrix
from eventlens.session import new_path, settle
from eventlens.sources import stores

_LONG = "long AS (" + "\nUNION ALL\n".join(ALL_PARTS["basic"]) + ")"
_CELLS = ", ".join(
    f"coalesce(max(value) FILTER (feature = '{f}'), 0) AS {f}" for f in MODEL_FEATURES
)


@query("feature_matrix", f"WITH {SC},\n{_LONG} SELECT scope, {_CELLS} FROM long GROUP BY scope")
def _(spark, sf):
    return rounded(basic_matrix(scoped(spark, sf), BY, failed_login=FAILED_LOGIN))


@query(
    "fill_with_mean",
    f"WITH {EV}, g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN execution_time END AS execution_time, "
    "CASE WHEN event_id % 5 <> 0 THEN CAST(packet_count AS DOUBLE) END AS packet_count FROM ev) "
    "SELECT event_id, round(coalesce(execution_time, (SELECT avg(execution_time) FROM g)), 6) AS execution_time, "
    "round(coalesce(packet_count, (SELECT avg(packet_count) FROM g)), 6) AS packet_count FROM g",
)
def _(spark, sf):
    gaps = events(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("execution_time")).alias("execution_time"),
        F.when(F.col("event_id") % 5 != 0, F.col("packet_count").cast("double")).alias("packet_count"),
    )
    return rounded(scaling.fill_with_mean(gaps, ["execution_time", "packet_count"]))


@query(
    "standardize",
    f"WITH {EV}, g AS (SELECT event_id, execution_time AS x, CAST(byte_count AS DOUBLE) AS y, CAST(7 AS DOUBLE) AS z FROM ev) "
    "SELECT event_id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS x, "
    "round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS y, z - 7 AS z FROM g",
)
def _(spark, sf):
    df = events(spark, sf).select(
        "event_id", F.col("execution_time").alias("x"), F.col("byte_count").cast("double").alias("y"), F.lit(7.0).alias("z")
    )
    return rounded(scaling.standardize(df, ["x", "y", "z"]))


@query(
    "score_summary",
    f"WITH {EV} SELECT date_trunc('day', timestamp) AS scope, round(avg(score), 6) AS mean_score, "
    "round(stddev_pop(score), 6) AS std_score, min(score) AS min_score, max(score) AS max_score, "
    "CAST(sum(prediction) AS BIGINT) AS anomalies FROM ev GROUP BY 1",
)
def _(spark, sf):
    df = scoped(spark, sf, 86400)
    counted = df.groupBy("scope").agg(F.sum("prediction").alias("anomalies"))
    return rounded(drift.score_summary(df, BY).join(counted, "scope"))


_DRIFT = """s AS (SELECT scope, avg(score) AS m, stddev_pop(score) AS d FROM sc GROUP BY scope),
b AS (SELECT avg(score) AS bm, stddev_pop(score) AS bd FROM sc),
dr AS (SELECT scope, abs(m - bm) / bd AS mean_drift, abs(d - bd) / bd AS std_drift FROM s, b)"""


def _drift(spark, sf):
    df = scoped(spark, sf)
    base = drift.score_summary(df).select(F.struct("mean_score", "std_score").alias("b")).scalar()
    return drift.score_drift(drift.score_summary(df, BY), base["mean_score"], base["std_score"])


@query(
    "score_drift",
    f"WITH {SC},\n{_DRIFT} SELECT scope, round(mean_drift, 6) AS mean_drift, round(std_drift, 6) AS std_drift, "
    "round(greatest(mean_drift, std_drift), 6) AS drift_metric, greatest(mean_drift, std_drift) > 0.1 AS drift_detected FROM dr",
)
def _(spark, sf):
    return rounded(_drift(spark, sf).select("scope", "mean_drift", "std_drift", "drift_metric", "drift_detected"))


@query(
    "drift_history",
    f"WITH {SC},\n{_DRIFT} SELECT scope AS timestamp, round(greatest(mean_drift, std_drift), 6) AS drift_metric, "
    "scope = max(scope) OVER () AS is_current FROM dr ORDER BY scope DESC LIMIT 100",
)
def _(spark, sf):
    records = _drift(spark, sf).select(F.col("scope").alias("timestamp"), "drift_metric")
    kept = settle(drift.newest(records, 100, tie="drift_metric"))
    current = drift.latest(kept, tie="drift_metric").select("timestamp").scalar()
    return rounded(kept.withColumn("is_current", F.col("timestamp") == current))


@query(
    "contamination_cutoff",
    f"WITH {EV} SELECT count(*) AS n, round(quantile_cont(0 - execution_time, 0.1), 6) AS quantile FROM ev",
)
def _(spark, sf):
    return rounded(exact_quantile(events(spark, sf).select((0 - F.col("execution_time")).alias("score")), "score", 0.1))


def _two_scorers(spark, sf):
    df = events(spark, sf)
    local = df.select("event_id", "prediction", (0 - F.col("score")).alias("score"))
    second = df.where(F.col("event_id") % 3 != 0).select(
        "event_id", F.col("second_prediction").alias("prediction"), F.col("second_score").alias("score")
    )
    return local, second


def _ensemble_sql(decided: str) -> str:
    return (
        f"WITH {EV} SELECT event_id, CAST({decided} > 0.5 AS INTEGER) AS prediction, "
        "round(0.5 * score + 0.5 * second_score, 6) AS score FROM ev WHERE event_id % 3 <> 0"
    )


@query("ensemble_weighted", _ensemble_sql("(0.5 * score + 0.5 * second_score)"))
def _(spark, sf):
    return rounded(Ensemble().combine(*_two_scorers(spark, sf)))


@query("ensemble_voting", _ensemble_sql("(0.5 * prediction + 0.5 * second_prediction)"))
def _(spark, sf):
    return rounded(Ensemble(method="voting").combine(*_two_scorers(spark, sf)))


# ---- second scorer ----

_RESULTS = (
    EV + ", rs AS (SELECT event_id, second_prediction AS prediction, second_score AS score, threat_category, "
    "CASE WHEN event_id % 5 = 0 THEN 'critical' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'command_pattern' END AS pattern_type, "
    "CASE WHEN event_id % 2 = 0 THEN 'lateral_movement' END AS behavior_type, protocol FROM ev)"
)


def _results(spark, sf):
    i = F.col("event_id")
    details = F.when(i % 2 == 0, F.create_map(F.lit("protocol"), F.col("protocol")))
    return events(spark, sf).select(
        "event_id",
        F.col("second_prediction").alias("prediction"),
        F.col("second_score").alias("score"),
        "threat_category",
        F.when(i % 5 == 0, "critical").alias("severity"),
        F.when(i % 3 == 0, "command_pattern").alias("pattern_type"),
        F.when(i % 2 == 0, "lateral_movement").alias("behavior_type"),
        details.alias("pattern_details"),
    )


@query("post_anomaly", f"WITH {_RESULTS} SELECT event_id, score FROM rs WHERE prediction = 1 AND score > 0.5")
def _(spark, sf):
    return postfilter.post_filter("anomaly_detection")(_results(spark, sf)).select("event_id", "score")


@query(
    "post_behavior",
    f"WITH {_RESULTS} SELECT event_id, score, coalesce(behavior_type, 'unknown') AS behavior_type FROM rs WHERE prediction = 1",
)
def _(spark, sf):
    return postfilter.post_filter("behavior_analysis")(_results(spark, sf)).select("event_id", "score", "behavior_type")


@query(
    "post_threat",
    f"WITH {_RESULTS} SELECT event_id, score, coalesce(threat_category, 'unknown') AS threat_category, "
    "coalesce(severity, 'medium') AS severity FROM rs WHERE prediction = 1 AND score > 0.7",
)
def _(spark, sf):
    kept = postfilter.post_filter("threat_detection")(_results(spark, sf))
    return kept.select("event_id", "score", "threat_category", "severity")


@query(
    "post_pattern",
    f"WITH {_RESULTS} SELECT event_id, score, coalesce(pattern_type, 'unknown') AS pattern_type, "
    "CASE WHEN event_id % 2 = 0 THEN concat('{\"protocol\":\"', protocol, '\"}') ELSE '{}' END AS pattern_details "
    "FROM rs WHERE prediction = 1 AND score > 0.6",
)
def _(spark, sf):
    kept = postfilter.post_filter("pattern_recognition")(_results(spark, sf))
    return kept.select("event_id", "score", "pattern_type", F.to_json("pattern_details").alias("pattern_details"))


@query(
    "post_zip",
    f"WITH {EV} SELECT event_id // 100 AS batch_id, CAST(event_id % 100 AS INTEGER) AS index, second_prediction AS prediction, "
    "second_score AS score, CASE WHEN event_id % 100 < 80 THEN event_type END AS event_type FROM ev WHERE event_id % 100 < 90",
)
def _(spark, sf):
    place = F.col("event_id") % 100
    df = events(spark, sf).select(
        F.floor(F.col("event_id") / 100).alias("batch_id"), place.cast("int").alias("index"), "event_type", "second_prediction", "second_score"
    )
    # Batches of 100 events; the scorer answered with fewer scores than predictions.
    answers = df.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("index", "second_prediction", "second_score"))).alias("a"))
    arrays = answers.select(
        "batch_id",
        F.transform("a", lambda x: x["second_prediction"]).alias("predictions"),
        F.transform(F.filter("a", lambda x: x["index"] < 90), lambda x: x["second_score"]).alias("scores"),
    )
    known = df.where(F.col("index") < 80).select("batch_id", "index", "event_type")
    return postfilter.attach_events(postfilter.zip_results(arrays), known)


# ---- evaluation ----

PREDICTED = "CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN 'N' ELSE 'R' END"


def _class_sql(where: str = "true") -> str:
    return f"""y AS (SELECT l_returnflag AS t, {PREDICTED} AS p FROM lineitem WHERE {where}),
l AS (SELECT t AS label FROM y UNION SELECT p FROM y),
c AS (SELECT label, (SELECT count(*) FROM y WHERE t = label AND p = label) AS hits, (SELECT count(*) FROM y WHERE t = label) AS support,
             (SELECT count(*) FROM y WHERE p = label) AS predicted FROM l),
m AS (SELECT label, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
             coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM c)"""


def _pairs(spark, sf, where: str = "true"):
    lines = table(spark, sf, "lineitem").where(where)
    return evaluation.label_pairs(lines, F.col("l_returnflag"), F.expr(PREDICTED))


_WEIGHTED = ", ".join(f"round(sum({m} * support) / sum(support), 6) AS {m}" for m in ("precision", "recall", "f1"))


@query("weighted_prf", f"WITH {_class_sql()} SELECT {_WEIGHTED} FROM m")
def _(spark, sf):
    return rounded(evaluation.weighted_scores(_pairs(spark, sf)))


@query(
    "confusion_matrix",
    f"WITH y AS (SELECT l_returnflag AS t, {PREDICTED} AS p FROM lineitem), l AS (SELECT unnest(['A', 'N', 'R', 'never']) AS v) "
    'SELECT a.v AS "true", b.v AS pred, (SELECT count(*) FROM y WHERE t = a.v AND p = b.v) AS n FROM l a, l b',
)
def _(spark, sf):
    return evaluation.confusion_matrix(_pairs(spark, sf), ["A", "N", "R", "never"])


@query("confusion_cells", f'SELECT l_returnflag AS "true", {PREDICTED} AS pred, count(*) AS n FROM lineitem GROUP BY ALL')
def _(spark, sf):
    return evaluation.confusion_matrix(_pairs(spark, sf))


@query(
    "class_report",
    f"WITH {_class_sql()} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m "
    f"UNION ALL SELECT 'weighted avg', {_WEIGHTED}, CAST(sum(support) AS BIGINT) FROM m",
)
def _(spark, sf):
    return rounded(evaluation.class_report(_pairs(spark, sf)))


def _auc_sql(source: str, group: str) -> str:
    return f"""y AS ({source}),
k AS (SELECT {group} AS g, t, rank() OVER (PARTITION BY {group} ORDER BY s) + (count(*) OVER (PARTITION BY {group}, s) - 1) / 2.0 AS r FROM y),
a AS (SELECT g, sum(r) FILTER (t = 1) AS ranks, count(*) FILTER (t = 1) AS p, count(*) FILTER (t <> 1) AS q FROM k GROUP BY g)
SELECT {{}}, round((ranks - p * (p + 1) / 2.0) / nullif(CAST(p AS DOUBLE) * q, 0), 6) AS roc_auc FROM a"""


_LABELLED = "SELECT quality AS t, n_chars % 97 AS s, lang FROM labels JOIN documents USING (doc_id)"


@query("roc_auc", "WITH " + _auc_sql(_LABELLED, "1").format("p + q AS n"))
def _(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    area = evaluation.roc_auc(df, F.col("quality"), F.col("n_chars") % 97)
    counted = df.agg(F.count("*")).scalar()
    return rounded(area.select(counted.alias("n"), "roc_auc"))


@query("roc_auc_by_type", f"WITH {EV}, " + _auc_sql("SELECT second_prediction AS t, execution_time AS s, event_type FROM ev", "event_type").format("g AS event_type"))
def _(spark, sf):
    return rounded(evaluation.roc_auc(events(spark, sf), F.col("second_prediction"), F.col("execution_time"), ["event_type"]))


def _metric_values(spark, sf, where):
    one = evaluation.weighted_scores(_pairs(spark, sf, where))
    return one.unpivot([], ["precision", "recall", "f1"], "metric", "value")


@query(
    "metric_drift",
    f"WITH a AS (WITH {_class_sql('l_quantity < 25')} SELECT sum(precision * support) / sum(support) AS precision, "
    "sum(recall * support) / sum(support) AS recall FROM m), "
    f"b AS (WITH {_class_sql('l_quantity >= 25')} SELECT sum(precision * support) / sum(support) AS precision, "
    "sum(recall * support) / sum(support) AS recall FROM m), "
    "d AS (SELECT 'precision' AS metric, abs(a.precision - b.precision) AS drift FROM a, b "
    "UNION ALL SELECT 'recall', abs(a.recall - b.recall) FROM a, b) "
    "SELECT metric, round(drift, 6) AS drift, drift > 0.1 AS exceeds, bool_or(drift > 0.1) OVER () AS drift_detected FROM d",
)
def _(spark, sf):
    reference = _metric_values(spark, sf, "l_quantity < 25")
    current = _metric_values(spark, sf, "l_quantity >= 25").where("metric <> 'f1'")
    compared = drift.metric_drift(reference, current)
    return rounded(compared.withColumn("drift_detected", drift.drift_detected(compared).scalar()))


@query(
    "evaluation_record",
    f"WITH {_class_sql()} SELECT {_WEIGHTED}, CAST(NULL AS DOUBLE) AS roc_auc, (SELECT CAST(count(*) AS INTEGER) FROM (SELECT DISTINCT t, p FROM y)) AS matrix_rows, "
    "(SELECT CAST(count(*) + 3 AS INTEGER) FROM l) AS report_rows FROM m",
)
def _(spark, sf):
    record = evaluation.evaluate(table(spark, sf, "lineitem"), F.col("l_returnflag"), F.expr(PREDICTED), "2024-01-31T00:00:00")
    return rounded(
        record.select(
            "precision", "recall", "f1", "roc_auc",
            F.size("confusion_matrix").alias("matrix_rows"), F.size("classification_report").alias("report_rows"),
        )
    )


# ---- forest: the algorithm is random by seed, so SQL cannot state its results ----


def _vectors(spark, sf):
    """Every entry of the vectors as a column."""
    vectors = table(spark, sf, "embeddings")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0]
    return vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(size)])


def _hourly(spark, sf):
    return settle(basic_matrix(scoped(spark, sf), BY, failed_login=FAILED_LOGIN))


@query("forest_train")
def _(spark, sf):
    matrix = _hourly(spark, sf)
    names = list(MODEL_FEATURES)
    scaled = scaling.Scaler.fit(matrix, names).transform(matrix)
    rows = matrix.count()
    per_tree = min(forest.SAMPLE, rows)
    return forest.grow(forest.sample_rows(scaled, BY, names, rows, sample=per_tree), per_tree)


@query("forest_score")
def _(spark, sf):
    matrix = _hourly(spark, sf)
    model = Detector.fit(matrix, BY, MODEL_FEATURES)
    return model.predict(matrix).withColumn("anomaly_score", 0 - F.col("score"))


@query("serving_score")
def _(spark, sf):
    vectors = _vectors(spark, sf)
    model = Detector.fit(vectors, ["vec_id"])
    gaps = vectors.withColumn("x0", F.when(F.col("vec_id") % 10 != 0, F.col("x0")))
    return model.predict(gaps, raw=True, fill="mean")


def _same(left, right, key):
    """Per key: do both predictions agree in label and score?"""
    a = left.select(key, F.struct("prediction", "score").alias("a"))
    b = right.select(key, F.struct("prediction", "score").alias("b"))
    return a.join(b, key).select(key, (F.col("a") == F.col("b")).alias("same"))


@query("model_roundtrip", "SELECT vec_id, true AS same FROM embeddings")
def _(spark, sf):
    vectors = _vectors(spark, sf)
    model = Detector.fit(vectors, ["vec_id"])
    loaded = stores.load_model(spark, stores.save_model(spark, model, new_path(spark, "model")))
    return _same(model.predict(vectors), loaded.predict(vectors), "vec_id")


@query(
    "forest_cutoff_share",
    f"WITH {SC} SELECT count(DISTINCT scope) AS scopes, CAST(ceil((count(DISTINCT scope) - 1) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS anomalies, "
    "true AS in_range FROM sc",
)
def _(spark, sf):
    matrix = _hourly(spark, sf)
    scored = Detector.fit(matrix, BY, MODEL_FEATURES).predict(matrix)
    return scored.agg(
        F.count("*").alias("scopes"),
        F.sum("prediction").alias("anomalies"),
        F.bool_and(F.col("score").between(-1, 0)).alias("in_range"),
    )


@query("model_summary")
def _(spark, sf):
    vectors = _vectors(spark, sf)
    return Detector.fit(vectors, ["vec_id"]).summary(vectors, {"local_weight": 0.5})


@query(
    "model_summary_facts",
    "SELECT 'IsolationForest' AS model_type, '1.0.0' AS model_version, CAST(max(len(embedding)) AS INTEGER) AS feature_count, true AS is_trained, "
    "count(*) AS training_samples, CAST(0.25 AS DOUBLE) AS local_weight, CAST(0.75 AS DOUBLE) AS second_weight, 'weighted' AS method FROM embeddings",
)
def _(spark, sf):
    vectors = _vectors(spark, sf)
    row = Detector.fit(vectors, ["vec_id"], trees=10).summary(vectors, {"local_weight": 0.25})
    return row.select("model_type", "model_version", "feature_count", "is_trained", "training_samples", "ensemble.*")


# A forest of two trees over the first, eleventh and last entry: (tree, node, feature, threshold, left, right, path).
HAND_NODES = [
    (0, 0, 0, 0.0, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 2.0), (0, 2, 63, 0.05, 3, 4, 0.0), (0, 3, -1, 0.0, -1, -1, 3.5), (0, 4, -1, 0.0, -1, -1, 4.25),
    (1, 0, 10, -0.02, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 1.5), (1, 2, -1, 0.0, -1, -1, 5.0),
]
_BY_HAND = (
    "SELECT vec_id, 0 - pow(2, 0 - ((CASE WHEN x0 < 0 THEN 2.0 WHEN CAST(embedding[64] AS DOUBLE) < 0.05 THEN 3.5 ELSE 4.25 END) "
    "+ (CASE WHEN CAST(embedding[11] AS DOUBLE) < -0.02 THEN 1.5 ELSE 5.0 END)) / 2.0 / (2 * (ln(255) + 0.5772156649) - 2 * 255 / 256.0)) AS score FROM v"
)


def by_hand(spark, sf):
    vectors = _vectors(spark, sf)
    names = tuple(c for c in vectors.columns if c != "vec_id")
    nodes = pd.DataFrame(HAND_NODES, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    plain = scaling.Scaler(names, (0.0,) * len(names), (1.0,) * len(names))
    return vectors, Detector(plain, forest.Forest(names, nodes, 256), -0.75)


BY_HAND_SQL = (
    f"WITH v AS (SELECT vec_id, embedding, CAST(embedding[1] AS DOUBLE) AS x0 FROM embeddings), s AS ({_BY_HAND}) "
    "SELECT vec_id, round(score, 6) AS score, CAST(score < -0.75 AS INTEGER) AS prediction FROM s"
)


@query("forest_score_by_hand", BY_HAND_SQL)
def _(spark, sf):
    vectors, model = by_hand(spark, sf)
    return rounded(model.predict(vectors))


@query(
    "serving_score_by_hand",
    "WITH g AS (SELECT vec_id, embedding, CASE WHEN vec_id % 3 <> 0 THEN CAST(embedding[1] AS DOUBLE) END AS x FROM embeddings), "
    f"v AS (SELECT vec_id, embedding, coalesce(x, (SELECT avg(x) FROM g)) AS x0 FROM g), s AS ({_BY_HAND}) "
    "SELECT vec_id, round(score, 6) AS score, CASE WHEN score < -0.75 THEN -1 ELSE 1 END AS prediction FROM s",
)
def _(spark, sf):
    vectors, model = by_hand(spark, sf)
    gaps = vectors.withColumn("x0", F.when(F.col("vec_id") % 3 != 0, F.col("x0")))
    return rounded(model.predict(gaps, raw=True, fill="mean"))


# ---- numbers and labels that are missing ----

NAN = float("nan")


@query(
    "nan_filters",
    f"WITH {_RESULTS} SELECT event_id, score > 0.5 AS anomaly, score > 0.7 AS threat, score > 0.6 AS pattern FROM rs WHERE prediction = 1 AND score > 0.5 AND event_id % 11 <> 0",
)
def _(spark, sf):
    results = _results(spark, sf).withColumn("score", F.when(F.col("event_id") % 11 == 0, NAN).otherwise(F.col("score")))
    kept = [postfilter.anomalies(results), postfilter.threats(results), postfilter.patterns(results)]
    ids = [k.select("event_id", F.lit(True).alias(n)) for k, n in zip(kept, ("anomaly", "threat", "pattern"), strict=True)]
    return ids[0].join(ids[1], "event_id", "left").join(ids[2], "event_id", "left").fillna(False)


@query(
    "nan_ensemble",
    f"WITH {EV} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(0.5 * score + 0.5 * second_score > 0.5 AS INTEGER) END AS prediction FROM ev WHERE event_id % 3 <> 0",
)
def _(spark, sf):
    local, second = _two_scorers(spark, sf)
    gaps = local.withColumn("score", F.when(F.col("event_id") % 11 == 0, NAN).otherwise(F.col("score")))
    return Ensemble().combine(gaps, second).select("event_id", "prediction")


@query(
    "roc_auc_unlabelled",
    "WITH " + _auc_sql(_LABELLED + " WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0", "1").format("p + q AS n"),
)
def _(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    true = F.when(F.col("doc_id") % 7 != 0, F.col("quality"))
    score = F.when(F.col("doc_id") % 5 == 0, NAN).otherwise((F.col("n_chars") % 97).cast("double"))
    counted = df.where("doc_id % 7 <> 0 and doc_id % 5 <> 0").agg(F.count("*")).scalar()
    return rounded(evaluation.roc_auc(df, true, score).select(counted.alias("n"), "roc_auc"))


@query(
    "nan_drift",
    f"WITH {SC}, s AS (SELECT scope, avg(score) FILTER (event_id % 11 <> 0) AS mean_score, stddev_pop(score) FILTER (event_id % 11 <> 0) AS std_score, "
    "min(score) FILTER (event_id % 11 <> 0) AS min_score, max(score) FILTER (event_id % 11 <> 0) AS max_score, count(*) FILTER (event_id % 11 = 0) AS missing FROM sc GROUP BY scope) "
    "SELECT scope, missing, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, min_score, max_score, "
    "round(greatest(abs(mean_score - 0.5) / 0.25, abs(std_score - 0.25) / 0.25), 6) AS drift_metric, "
    "greatest(abs(mean_score - 0.5) / 0.25, abs(std_score - 0.25) / 0.25) > 0.1 AS drift_detected FROM s",
)
def _(spark, sf):
    spoilt = scoped(spark, sf).withColumn("score", F.when(F.col("event_id") % 11 == 0, NAN).otherwise(F.col("score")))
    drifts = drift.score_drift(drift.score_summary(spoilt, ["scope"]), F.lit(0.5), F.lit(0.25))
    return rounded(drifts.join(drift.missing_scores(spoilt, ["scope"]), "scope").drop("rows", "mean_drift", "std_drift"))


@query(
    "nan_standardize",
    f"WITH {EV}, k AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN execution_time END AS v FROM ev) "
    "SELECT event_id, round((v - avg(v) OVER ()) / nullif(stddev_pop(v) OVER (), 0), 6) AS lazy, "
    "round((v - avg(v) OVER ()) / nullif(stddev_pop(v) OVER (), 0), 6) AS fitted FROM k",
)
def _(spark, sf):
    spoilt = events(spark, sf).select("event_id", F.when(F.col("event_id") % 11 == 0, NAN).otherwise(F.col("execution_time")).alias("v"))
    lazy = scaling.standardize(spoilt, ["v"]).select("event_id", F.nanvl("v", F.lit(None).cast("double")).alias("lazy"))
    fitted = scaling.Scaler.fit(spoilt, ["v"]).transform(spoilt).select("event_id", F.nanvl("v", F.lit(None).cast("double")).alias("fitted"))
    return rounded(lazy.join(fitted, "event_id"))


# ---- records that are stored and read back ----


@query(
    "evaluation_stored",
    f"""WITH {_class_sql()}, q AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS t, l_quantity AS s FROM lineitem),
k AS (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM q),
a AS (SELECT sum(r) FILTER (t = 1) AS ranks, count(*) FILTER (t = 1) AS p, count(*) FILTER (t <> 1) AS n FROM k),
w AS (SELECT {_WEIGHTED} FROM m), c2 AS (SELECT (t = 'A')::INT AS t, (p = 'A')::INT AS p FROM y)
SELECT CAST(3 AS BIGINT) AS seq, '2024-01-31T00:00:00' AS timestamp, CAST(t AS VARCHAR) AS "true", CAST(p AS VARCHAR) AS pred, count(*) AS n,
       (SELECT round((ranks - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 6) FROM a) AS roc_auc,
       (SELECT count(*) FROM c2 WHERE t = 1) AS support_of_1, '{{"epochs": 5, "model_type": "IsolationForest"}}' AS model_info
FROM c2 GROUP BY t, p""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    true, predicted = (F.col("l_returnflag") == "A").cast("int"), (F.expr(PREDICTED) == "A").cast("int")
    info = {"model_type": "IsolationForest", "epochs": 5}
    record = evaluation.evaluate(lines, true, predicted, "2024-01-31T00:00:00", F.col("l_quantity"), info, 3)
    stored = stores.read_metrics(spark, stores.write_metrics(record, new_path(spark, "metrics")))
    cells = F.from_json("confusion_matrix", "array<struct<`true`: string, pred: string, n: bigint>>")
    report = F.from_json("classification_report", "map<string, struct<support: bigint>>")
    return rounded(
        stored.select("seq", "timestamp", "roc_auc", "model_info", F.element_at(report, "1")["support"].alias("support_of_1"), F.inline(cells))
    )


@query(
    "drift_stored",
    f"WITH {SC},\n{_DRIFT} SELECT scope AS timestamp, round(mean_drift, 6) AS mean_drift FROM dr WHERE scope < TIMESTAMP '2024-01-03' ORDER BY scope DESC LIMIT 10",
)
def _(spark, sf):
    path = new_path(spark, "drift")
    early = _drift(spark, sf).where("scope < timestamp_ntz'2024-01-03'")
    stores.append_drift(early, path, F.col("scope"))
    return rounded(drift.newest(spark.read.parquet(path), 10, tie="drift_metric").select("timestamp", "mean_drift"))
