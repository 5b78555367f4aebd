"""The test tables in the shape of security events, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlens.operators.features import with_scope
from eventlens.session import configure

# On this data an 'error' event plays the failed login.
FAILED_LOGIN = "error"

_PROJECTION = """
SELECT event_id,
       ts AS timestamp,
       event_type,
       concat('user_', user_id) AS username,
       concat('192.168.1.', user_id % 254 + 1) AS source_ip,
       concat('10.0.0.', k % 16 + 1) AS destination_ip,
       concat('process_', k % 5 + 1) AS process_name,
       CASE WHEN k % 25 <> 0 THEN concat(event_type, ' --k=', k % 20) END AS command,
       CASE WHEN k % 10 = 0 THEN 'README'
            ELSE concat('/srv/d', k % 4, '/f_', k % 10, '.',
                        CASE k % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'log' ELSE 'conf' END) END AS file_path,
       concat('--k=', k % 20) AS arguments,
       CASE k % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
       concat('sys_', k % 7) AS syscall,
       concat('parent_', k % 6) AS parent_process,
       k % 15 + 1 AS alert_level,
       CAST(k + 1 AS BIGINT) AS packet_count,
       CAST((k + 1) * 64 AS BIGINT) AS byte_count,
       concat('conn_', event_id % 500) AS connection_id,
       value AS execution_time,
       k / CAST(100 AS DOUBLE) AS score,
       CASE WHEN k >= 90 THEN 1 ELSE 0 END AS prediction,
       (user_id % 100) / CAST(100 AS DOUBLE) AS second_score,
       CASE WHEN event_id % 10 < 3 THEN 1 ELSE 0 END AS second_prediction,
       CASE event_id % 4 WHEN 0 THEN 'malware' WHEN 1 THEN 'exploit' WHEN 2 THEN 'data_exfiltration' END AS threat_category
FROM {base}
"""

_BASE = "(SELECT event_id, ts, user_id, event_type, value, CAST({k} AS INT) AS k FROM {table})"
_SPARK_K = "get_json_object(props, '$.k')"
_SQL_K = "json_extract_string(props, '$.k')"


def project(raw: DataFrame) -> DataFrame:
    """Security events with scores from the raw ``events`` table; also for streams."""
    return raw.sparkSession.sql(_PROJECTION.format(base=_BASE.format(k=_SPARK_K, table="{raw}")), raw=raw)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return project(table(spark, sf, "events"))


def scoped(spark: SparkSession, sf: str, seconds: int = 3600) -> DataFrame:
    return with_scope(events(spark, sf), seconds)


EV = "ev AS (" + _PROJECTION.format(base=_BASE.format(k=_SQL_K, table="events")) + ")"
SC = EV + ",\nsc AS (SELECT date_trunc('hour', timestamp) AS scope, * FROM ev)"
DAY = EV + ",\nsc AS (SELECT date_trunc('day', timestamp) AS scope, * FROM ev)"
