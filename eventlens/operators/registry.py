"""Records of model versions and experiments, kept as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.functions.ids import content_id, experiment_content_id
from eventlens.operators.ranked import first_ranked


def version_records(models: DataFrame) -> DataFrame:
    """(version_id, timestamp, model_info, metrics, model_path) from rows without the id."""
    return models.select(
        content_id(F.col("model_info"), models.schema["model_info"].dataType).alias("version_id"),
        "timestamp",
        "model_info",
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"),
        "model_path",
    )


def experiment_records(experiments: DataFrame) -> DataFrame:
    """(experiment_id, name, description, parameters, timestamp, status) of new experiments."""
    return experiments.select(
        experiment_content_id(F.col("name"), F.col("parameters"), experiments.schema["parameters"].dataType).alias("experiment_id"),
        "name",
        "description",
        "parameters",
        "timestamp",
        F.lit("created").alias("status"),
    )


def latest_records(log: DataFrame, key: str, ts: str = "timestamp", *, tie: str) -> DataFrame:
    """The last record per key of an append-only log: writing a key again replaces its record. ``tie`` decides between equal times."""
    return first_ranked(log, [key], _newest_first(ts, tie), 1)


def keep_newest(records: DataFrame, group: str, keep: int = 5, ts: str = "timestamp", *, tie: str) -> DataFrame:
    """The newest ``keep`` records per group."""
    return first_ranked(records, [group], _newest_first(ts, tie), keep)


def _newest_first(ts: str, tie: str) -> list[Column]:
    return [F.desc(ts), F.desc(tie)]


def lookup(records: DataFrame, key: str, value: str) -> DataFrame:
    """The record with this id; raises when there is none."""
    found = records.where(F.col(key) == value)
    if found.isEmpty():
        raise ValueError(f"{key} {value} not found")
    return found


def list_records(records: DataFrame, key: str, readable: Column | None = None) -> DataFrame:
    """Records newest first, then by ``key``, without unreadable ones."""
    if readable is not None:
        records = records.where(readable)
    return records.orderBy(F.desc("timestamp"), key)


def add_versions(links: DataFrame, added: DataFrame, experiments: DataFrame) -> DataFrame:
    """(experiment_id, version_id): the membership table with ``added`` rows, each link once.

    An experiment's versions are rows here, so it may have any number. A link to no experiment raises.
    """
    orphan = added.join(experiments, "experiment_id", "left_anti").first()
    if orphan is not None:
        raise ValueError(f"experiment {orphan['experiment_id']} not found")
    keys = ["experiment_id", "version_id"]
    return links.select(*keys).unionByName(added.select(*keys)).distinct()


def new_links(links: DataFrame, added: DataFrame) -> DataFrame:
    """Links that are not there yet, once each: what an append to the membership table must write."""
    keys = ["experiment_id", "version_id"]
    return added.select(*keys).distinct().join(links.select(*keys), keys, "left_anti")


def experiments_with_counts(experiments: DataFrame, links: DataFrame) -> DataFrame:
    """Experiments with their number of versions."""
    counts = links.groupBy("experiment_id").agg(F.count("*").alias("versions"))
    return experiments.join(counts, "experiment_id", "left").fillna(0, ["versions"])
