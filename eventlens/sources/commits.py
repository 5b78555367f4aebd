"""Datasets whose writes appear at once.

Every write is a folder of its own below ``parts``, and a row in ``commits`` that is written when the folder is
whole. Readers open the folders of the commits they find, so a write that broke off, or is still going on, is
invisible, and a write that replaces the ones before it is seen either wholly or not at all. ``compact``
replaces many writes by one, and ``vacuum`` deletes folders that no reader will open any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

COMMIT = "part string, at timestamp, replaces boolean"
PART = "part"


def new_part() -> str:
    # A letter in front, so that no reader takes the name for a number.
    return f"w{uuid.uuid4().hex}"


def part_path(path: str, part: str) -> str:
    return f"{path}/parts/{PART}={part}"


def commit(spark: SparkSession, path: str, part: str, replace: bool = False) -> None:
    """Make a part visible; with ``replace`` it hides all parts before it."""
    row = spark.createDataFrame([(part, datetime.now(timezone.utc), replace)], COMMIT)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def write_part(df: DataFrame, path: str, by: Sequence[str] = (), replace: bool = False, fmt: str = "parquet") -> str:
    """Write ``df`` as a part in folders of ``by``, and commit it."""
    part = new_part()
    df.write.partitionBy(*by).format(fmt).save(part_path(path, part))
    commit(df.sparkSession, path, part, replace)
    return part


def live_parts(spark: SparkSession, path: str) -> list[str]:
    """The parts to read, oldest first: all since the last one that replaces. One row per write comes to the driver."""
    rows = spark.read.schema(COMMIT).parquet(f"{path}/commits").orderBy("at", "part").collect()
    first = max((i for i, r in enumerate(rows) if r["replaces"]), default=0)
    return [r["part"] for r in rows[first:]]


def read_parts(spark: SparkSession, path: str, parts: Sequence[str], schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """The rows of some parts, with the part's name in the column ``part``."""
    reader = spark.read.option("basePath", f"{path}/parts").format(fmt)
    if schema is not None:
        reader = reader.schema(schema.add(PART, "string") if PART not in schema.names else schema)
    return reader.load([part_path(path, p) for p in parts])


def write_order(parts: Sequence[str]) -> Column:
    """The position of a row's part among ``parts``, from 1."""
    return F.array_position(F.array(*[F.lit(p) for p in parts]), F.col(PART))


def compact(spark: SparkSession, path: str, read: Callable[[], DataFrame], by: Sequence[str] = ()) -> str:
    """Write what readers see now as one part in the place of all others.

    Nobody else may write meanwhile: a part committed between the read and the end would be hidden.
    """
    return write_part(read(), path, by, replace=True)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that are not live: hidden ones, and those of writes that broke off. Returns their number.

    Only when nobody writes or still reads an older state.
    """
    live = {f"{PART}={p}" for p in live_parts(spark, path)}
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in live]
    for old in gone:
        files.delete(old, True)
    return len(gone)
