"""Event batches in and out."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from eventlens.schema import EVENT_SCHEMA, JSON_TEXT, JSON_TIME, REQUIRED, complete

log = logging.getLogger(__name__)

def read_events(spark: SparkSession, path: str, fmt: str = "parquet", strict: bool = True) -> DataFrame:
    """Events of a parquet or JSON-lines folder in the event schema; absent columns are null.

    An event needs a time and a type. A JSON line that does not fit or lacks one of them raises; when not
    ``strict`` it is left out, and ``rejected_events`` has it. So do parquet rows without one of them.
    """
    if fmt == "parquet":
        events = complete(spark.read.parquet(path))
    elif fmt == "json" and strict:
        events = complete(spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST").options(**JSON_TIME_READ).json(path))
    elif fmt == "json":
        return complete(_json_lines(spark, path).where(_usable(F.col(BROKEN))))
    else:
        raise ValueError(f"unknown format: {fmt}")
    if not strict:
        return events.where(_usable(F.lit(None)))
    checked = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"an event has no {c}")).cast(EVENT_SCHEMA[c].dataType)) for c in REQUIRED}
    return events.withColumns(checked)


def rejected_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """What ``read_events`` leaves out when not strict: rows in the event schema, JSON ones with the text of a line that does not fit."""
    if fmt == "parquet":
        return complete(spark.read.parquet(path)).where(~_usable(F.lit(None)))
    lines = _json_lines(spark, path)
    return lines.where(~_usable(F.col(BROKEN))).withColumnRenamed(BROKEN, "line")


BROKEN = "__broken"
JSON_TIME_READ = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"}


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, **JSON_TIME_READ}
    # A filter on the broken line alone would be answered without parsing the rest.
    return spark.read.schema(schema).options(**options).json(path).withColumn(BROKEN, F.col(BROKEN))


def _usable(broken: Column) -> Column:
    return broken.isNull() & reduce(Column.__and__, [F.col(c).isNotNull() for c in REQUIRED])


def write_events(events: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Events as a parquet or JSON-lines folder."""
    events.write.mode(mode).options(**(JSON_TIME if fmt == "json" else {})).format(fmt).save(path)


def warn_if_empty(events: DataFrame) -> DataFrame:
    """The same table, with a warning in the log when it has no row."""
    if events.isEmpty():
        log.warning("no events to process")
    return events


def event_records(df: DataFrame, columns: list[str], timestamp: Column | str, source: str = "hybrid_detector") -> DataFrame:
    """(event, timestamp, source): each row as a JSON record with the time and origin of the request, both given by the caller."""
    at = F.lit(timestamp).cast("timestamp_ntz") if isinstance(timestamp, str) else timestamp
    return df.select(F.to_json(F.struct(*columns), JSON_TEXT).alias("event"), at.alias("timestamp"), F.lit(source).alias("source"))


def _parsed(payload: Column, row_schema: T.StructType) -> tuple[Column, Column]:
    """(rows, whether the payload cannot be used): it is no JSON, or its lists differ in length."""
    broken = T.StructField(BROKEN, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    lists = T.StructType([*[T.StructField(f.name, T.ArrayType(f.dataType)) for f in row_schema.fields], broken])
    columns = F.from_json(payload, lists, options)
    none = F.array()
    # A list that is not there is a column of nulls.
    zipped = F.arrays_zip(
        *[F.coalesce(columns[f.name], none.cast(T.ArrayType(f.dataType))).alias(f.name) for f in row_schema.fields]
    )
    sizes = F.filter(F.array(*[F.size(columns[f.name]) for f in row_schema.fields]), lambda n: n >= 0)
    records = F.from_json(payload, T.ArrayType(T.StructType([*row_schema.fields, broken])), options)
    listed = F.ltrim(payload).startswith("[")
    own = F.transform(records, lambda r: F.struct(*[r[f.name].alias(f.name) for f in row_schema.fields]))
    rows = F.when(listed, own).otherwise(zipped.cast(T.ArrayType(row_schema)))
    bad_records = records.isNull() | F.exists(records, lambda r: r[BROKEN].isNotNull())
    bad_lists = columns[BROKEN].isNotNull() | (F.array_min(sizes) < F.array_max(sizes))
    bad = F.when(listed, bad_records).otherwise(bad_lists)
    return rows, F.coalesce(bad, F.lit(False)) | payload.isNull()


def _row_schema(row_schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(row_schema) if isinstance(row_schema, str) else row_schema


def payload_rows(
    df: DataFrame, payload: Column, row_schema: T.StructType | str, keep: tuple[str, ...] = (), strict: bool = True
) -> DataFrame:
    """Rows of a JSON payload: a list of records, or one record of lists that are zipped by position.

    A payload that is null, no JSON, or has lists of different length raises; when not ``strict`` it
    gives no rows, and ``payload_rejects`` has it.
    """
    rows, bad = _parsed(payload, _row_schema(row_schema))
    refused = F.raise_error(F.concat(F.lit("unusable payload: "), F.coalesce(F.left(payload, F.lit(80)), F.lit("null"))))
    kept = F.when(~bad, rows) if not strict else F.when(bad, refused.cast(T.ArrayType(_row_schema(row_schema)))).otherwise(rows)
    # The outer form keeps Spark from parsing each payload once more to look for empty lists.
    listed = df.select(*keep, F.posexplode_outer(kept).alias("__place", "__row"))
    return listed.where(F.col("__place").isNotNull()).select(*keep, "__row.*")


def payload_rejects(df: DataFrame, payload: Column, row_schema: T.StructType | str) -> DataFrame:
    """The rows of ``df`` whose payload cannot be used."""
    return df.where(_parsed(payload, _row_schema(row_schema))[1])
