"""Stored incidents, metrics and models."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from eventlens.operators.detector import Detector
from eventlens.operators.drift import record
from eventlens.operators.forest import NODE_SCHEMA, Forest
from eventlens.operators.incidents import get_incident
from eventlens.operators.ranked import first_ranked
from eventlens.operators.registry import latest_records
from eventlens.operators.scaling import Scaler
from eventlens.schema import INCIDENT_SCHEMA, METRICS_SCHEMA
from eventlens.sources import commits

DAY = "dt"


def write_incidents(incidents: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """One write of incidents, partitioned by day; a large day is written by several tasks.

    Readers take the last write of an id, so writing again replaces. ``mode='overwrite'`` replaces all.
    """
    day = F.substring("timestamp", 1, 10)
    commits.write_part(incidents.withColumn(DAY, day).hint("rebalance", DAY), path, [DAY], _replaces(mode), fmt)


def write_incident_events(hits: DataFrame, path: str, mode: str = "append") -> None:
    """One write of incidents' events (``high_score_events``), rows with ``incident_id``, partitioned by day.

    An incident's events may come in several writes; of an event that comes again the last write counts.
    ``mode='overwrite'`` replaces all.
    """
    day = F.date_format("window", "yyyy-MM-dd")
    commits.write_part(hits.withColumn(DAY, day).hint("rebalance", DAY), path, [DAY], _replaces(mode))


def _replaces(mode: str) -> bool:
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode is append or overwrite, not {mode}")
    return mode == "overwrite"


def read_incident_events(spark: SparkSession, path: str, incident: DataFrame | None = None) -> DataFrame:
    """The stored events of all incidents, or of one when its row is given, reading only that day.

    Rows without an event id cannot be told apart and are all kept.
    """
    parts = commits.live_parts(spark, path)
    stored = commits.read_parts(spark, path, parts).withColumn(WRITE, commits.write_order(parts))
    if incident is not None:
        one = incident.select("id", F.substring("timestamp", 1, 10).alias("day")).first()
        stored = stored.where(F.col(DAY).cast("string").eqNullSafe(F.lit(one["day"])) & (F.col("incident_id") == one["id"]))
    if len(parts) > 1:
        known = first_ranked(stored.where(F.col("event_id").isNotNull()), ["incident_id", "event_id"], [F.desc(WRITE)], 1)
        stored = known.unionByName(stored.where(F.col("event_id").isNull()))
    return stored.drop(DAY, WRITE, commits.PART)


# The number of the write that a row came with.
WRITE = "__write"


def read_incidents(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Stored incidents, each as last written, reading only the days between the ISO times, both inclusive."""
    parts = commits.live_parts(spark, path)
    schema = T.StructType([*INCIDENT_SCHEMA.fields, T.StructField(DAY, T.StringType())])
    stored = commits.read_parts(spark, path, parts, schema, fmt).withColumn(WRITE, commits.write_order(parts))
    if start is not None:
        stored = stored.where((F.col(DAY) >= start[:10]) & (F.col("timestamp") >= start))
    if end is not None:
        stored = stored.where((F.col(DAY) <= end[:10]) & (F.col("timestamp") <= end))
    return latest_records(stored, "id", WRITE, tie="timestamp").drop(DAY, WRITE, commits.PART)


def compact_incidents(spark: SparkSession, path: str) -> None:
    """All writes of incidents as one, without those that later ones replaced."""
    commits.compact(spark, path, lambda: read_incidents(spark, path).withColumn(DAY, F.substring("timestamp", 1, 10)).hint("rebalance", DAY), [DAY])


def compact_incident_events(spark: SparkSession, path: str) -> None:
    """All writes of incidents' events as one, without those that later ones replaced."""
    commits.compact(spark, path, lambda: read_incident_events(spark, path).withColumn(DAY, F.date_format("window", "yyyy-MM-dd")).hint("rebalance", DAY), [DAY])


def find_incident(spark: SparkSession, path: str, incident: str, day: str | None = None) -> DataFrame:
    """One stored incident; the id filter reaches the parquet scan, and ``day`` opens that day's files only. Raises when there is none."""
    bounds = (day, f"{day}T23:59:59") if day else (None, None)
    return get_incident(read_incidents(spark, path, *bounds), incident)


def scan_incident_files(spark: SparkSession, path: str, files: str = "*.json", whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(incidents, unreadable records) of a folder of JSON; files of other names are skipped.

    A file holds one record per line, or with ``whole_files`` one record in any layout.
    """
    broken = "__broken"
    schema = "id string, title string, severity string, timestamp string, description string, "
    schema += f"max_score double, event_count bigint, model_info map<string,string>, {broken} string"
    rows = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", broken)
        .option("pathGlobFilter", files)
        .option("recursiveFileLookup", "true")
        .option("multiLine", str(whole_files).lower())
        .json(path)
    )
    usable = F.col(broken).isNull() & F.col("id").isNotNull()
    return rows.where(usable).drop(broken), rows.where(~usable)


def write_metrics(history: DataFrame, path: str) -> str:
    """Metrics records as CSV with a header; nested columns become JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
        for f in history.schema.fields
    ]
    history.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics records of a CSV folder; ``seq`` gives their order."""
    return spark.read.schema(METRICS_SCHEMA).option("header", True).option("escape", '"').csv(path)


def current_metrics(history: DataFrame) -> DataFrame:
    """The last record; the time decides between records of one number."""
    return history.agg(F.max_by(F.struct(*history.columns), F.struct("seq", "timestamp")).alias("r")).select("r.*")


def append_drift(drifts: DataFrame, path: str, timestamp: Column | str) -> None:
    """Add a row of ``Detector.drift`` to a stored drift history; read the folder and take ``drift.newest`` of it."""
    record(drifts, timestamp).write.mode("append").parquet(path)


MODEL_PARTS = ("nodes", "features", "info")


def save_model(spark: SparkSession, model: Detector, path: str) -> str:
    """A detector as three small tables: forest nodes, features with their scaling, and its facts.

    They are one version, which readers see when all three are there; until then they get the one before.
    """
    scaling = [
        (i, f, m, s)
        for i, (f, m, s) in enumerate(zip(model.scaler.features, model.scaler.means, model.scaler.stds, strict=True))
    ]
    info = [(model.forest.sample, model.offset, json.dumps(model.info, sort_keys=True))]
    tables = {
        "nodes": spark.createDataFrame(model.forest.nodes, NODE_SCHEMA),
        "features": spark.createDataFrame(scaling, "position int, feature string, mean double, std double"),
        "info": spark.createDataFrame(info, "sample int, offset double, info string"),
    }
    version = commits.new_part()
    for name, table in tables.items():
        table.write.parquet(f"{commits.part_path(path, version)}/{name}")
    commits.commit(spark, path, version, replace=True)
    return path


def load_model(spark: SparkSession, path: str) -> Detector:
    """The last whole version that ``save_model`` wrote; raises when there is none, or a part is missing."""
    try:
        version = commits.part_path(path, commits.live_parts(spark, path)[-1])
    except Exception as error:
        raise FileNotFoundError(f"no model below {path}; train the model first") from error
    parts = {}
    for part in MODEL_PARTS:
        try:
            parts[part] = spark.read.parquet(f"{version}/{part}").toPandas()
        except Exception as error:
            raise FileNotFoundError(f"model part {part} not found below {path}; train the model first") from error
    features = parts["features"].sort_values("position")
    names = tuple(features["feature"])
    scaler = Scaler(names, tuple(features["mean"]), tuple(features["std"]))
    nodes = parts["nodes"].sort_values(["tree", "node"]).reset_index(drop=True)
    facts = parts["info"].iloc[0]
    info: Mapping = json.loads(facts["info"])
    return Detector(scaler, Forest(names, nodes, int(facts["sample"])), float(facts["offset"]), dict(info))
