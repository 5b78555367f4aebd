"""Schemas of the tables that the package reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from eventlens.functions.numbers import known

# JSON text keeps whole microseconds and names nulls.
JSON_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
JSON_TEXT = {"ignoreNullFields": "false", **JSON_TIME}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("arguments", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("syscall", T.StringType()),
        T.StructField("parent_process", T.StringType()),
        T.StructField("alert_level", T.IntegerType()),
        T.StructField("packet_count", T.LongType()),
        T.StructField("byte_count", T.LongType()),
        T.StructField("connection_id", T.StringType()),
        T.StructField("execution_time", T.DoubleType()),
    ]
)

REQUIRED = ("timestamp", "event_type")

INCIDENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("max_score", T.DoubleType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("model_info", T.MapType(T.StringType(), T.StringType())),
    ]
)

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("confusion_matrix", T.StringType()),
        T.StructField("classification_report", T.StringType()),
        T.StructField("model_info", T.StringType()),
    ]
)


def complete(df: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """All columns of ``schema`` in order, cast to its types; absent optional ones and NaN become nulls."""
    missing = [c for c in REQUIRED if c in schema.names and c not in df.columns]
    if missing:
        raise ValueError(f"events lack required columns: {', '.join(missing)}")
    def column(f: T.StructField) -> Column:
        value = (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType)
        return (known(value) if f.dataType.typeName() == "double" else value).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])
