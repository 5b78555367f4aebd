"""Running streams: to a table, or batch by batch with tables as memory.

All state that these jobs add is written to the shared folder under the batch's number, so a
repeated batch replaces its own files and nothing counts twice.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from eventlens.functions import moments
from eventlens.operators import drift, ordered
from eventlens.session import new_path


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append it to a parquet folder and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there, handing each micro-batch to ``handle`` together with its number."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class LateRows:
    """Rows that a stream dropped because they came after the watermark, added up over all batches.

    Spark keeps the reports of the last batches only, so ``update`` has to be called while the stream runs,
    before that many batches have gone by; ``finish`` does.
    """

    def __init__(self) -> None:
        self.by_batch: dict[tuple[str, int], int] = {}

    def update(self, query: StreamingQuery) -> int:
        for p in query.recentProgress:
            dropped = sum(op.get("numRowsDroppedByWatermark", 0) for op in p.get("stateOperators", []))
            key = (str(p["runId"]), int(p["batchId"]))
            # A batch without data may repeat a number's report; its rows count once.
            self.by_batch[key] = max(dropped, self.by_batch.get(key, 0))
        return self.total

    @property
    def total(self) -> int:
        return sum(self.by_batch.values())


class LateRowListener(StreamingQueryListener):
    """Rows that streams dropped because they came after the watermark, added up as Spark reports each batch.

    Nobody has to ask in time: a stream may run for any number of batches. ``late_rows`` attaches one.
    """

    def __init__(self) -> None:
        self._changed = threading.Condition()
        self._totals: dict[str, int] = {}
        # The last report of a run: its batch and the rows counted for it.
        self._last: dict[str, tuple[int, int]] = {}
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        with self._changed:
            self._totals.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run, batch = str(progress.runId), progress.batchId
        dropped = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        with self._changed:
            last, counted = self._last.get(run, (-1, 0))
            # A batch without data may repeat a number's report; its rows count once.
            counted = counted if batch == last else 0
            self._totals[run] = self._totals.get(run, 0) + max(0, dropped - counted)
            self._last[run] = (batch, max(dropped, counted))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def total(self, query: StreamingQuery, wait: float = 60.0) -> int:
        """Dropped rows of a query so far; of one that has ended, all of them, as reports come in order."""
        run = str(query.runId)
        with self._changed:
            if not query.isActive:
                self._changed.wait_for(lambda: run in self._ended, wait)
            return self._totals.get(run, 0)


@contextmanager
def late_rows(spark: SparkSession) -> Iterator[LateRowListener]:
    """A listener for the queries that are started inside."""
    listener = LateRowListener()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def finish(query: StreamingQuery, late: LateRows | None = None) -> int:
    """Wait for the end; a failed query raises. Returns the number of rows that came too late."""
    late = late or LateRows()
    while not query.awaitTermination(1):
        late.update(query)
    return late.update(query)


def collect_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into a new folder of the shared directory, and read that."""
    path = new_path(spark, name)
    finish(run_to_table(stream, f"{path}/out", f"{path}/state"))
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stage_by_window(events: DataFrame, path: str, seconds: int, columns: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to a table partitioned by batch and day, with the start of each row's window."""

    def write(batch: DataFrame, number: int) -> None:
        scoped = batch.withColumn("scope", F.window("timestamp", f"{seconds} seconds").start)
        rows = scoped.select("scope", *columns, F.to_date("scope").alias("day"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    return run_batches(events, write, checkpoint)


def closed_transitions(
    staged: DataFrame,
    seconds: int,
    delay_seconds: int,
    values: dict[str, Column],
    order: Sequence[str] = ("timestamp", "event_id"),
    after: str | None = None,
) -> DataFrame:
    """Transition counts of the staged windows that ended before the newest time less the delay.

    Neighbours need the whole window, so they are found when it is closed, with the batch operator
    and its protection against huge windows, instead of a list in the stream's state. ``after`` is
    the end of the last window counted by an earlier call; what comes late for it is left out.
    """
    newest = staged.agg(F.max("timestamp")).scalar()
    end = F.col("scope") + F.expr(f"INTERVAL {seconds} SECONDS")
    closed = staged.where(end <= newest - F.expr(f"INTERVAL {delay_seconds} SECONDS"))
    if after is not None:
        start = F.lit(after).cast(staged.schema["scope"].dataType)
        closed = closed.where(F.col("scope") >= start)
        if "day" in staged.columns:  # opens the files of these days only
            closed = closed.where(F.col("day") >= F.to_date(start))
    return ordered.transition_counts(closed, ["scope"], list(order), values)


def record_drift(path: str, baseline_mean: float, baseline_std: float) -> Callable[[DataFrame, int], None]:
    """A batch handler that appends one drift record per micro-batch of scored rows."""

    def write(batch: DataFrame, number: int) -> None:
        current = drift.score_summary(batch).where(F.col("mean_score").isNotNull())
        record = drift.score_drift(current, F.lit(baseline_mean), F.lit(baseline_std))
        record.select(
            F.lit(number).cast("bigint").alias("batch_id"),
            F.current_timestamp().alias("timestamp"),
            "drift_metric",
            "mean_drift",
            "std_drift",
            "drift_detected",
        ).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


DRIFT_STATE = f"batch_id bigint, own {moments.TYPE}, total {moments.TYPE}"


def accumulate_drift(path: str, score: str = "score") -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps a mergeable summary of the scores: each batch's own, and that of all batches so far.

    A batch reads the one row of the batch before it and writes its own under its number, so a repeated batch
    replaces its row and the work per batch does not grow. See ``drift_history``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.agg(moments.moments(F.col(score)).alias("own"))
        before = moments.nothing()
        if number:
            before = spark.read.schema(DRIFT_STATE).parquet(f"{path}/batch={number - 1}").agg(F.max_by("total", "batch_id")).scalar()
        row = own.select(F.lit(number).cast("bigint").alias("batch_id"), "own", moments.merged(before, F.col("own")).alias("total"))
        row.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drift_history(spark: SparkSession, path: str, baseline_mean: float, baseline_std: float) -> DataFrame:
    """Per batch of ``accumulate_drift``, of its own scores (part ``batch``) and of all so far (``total``): rows, missing, their summary and drift."""
    state = spark.read.schema(DRIFT_STATE).parquet(f"{path}/batch=*")
    parts = F.array(*[F.struct(F.lit(name).alias("part"), F.col(c).alias("m")) for name, c in (("batch", "own"), ("total", "total"))])
    m = F.col("m")
    summary = state.select("batch_id", F.inline(parts)).select(
        "batch_id", "part", m["n"].alias("rows"), m["missing"].alias("missing"), m["mean"].alias("mean_score"),
        moments.deviation(m).alias("std_score"), m["lo"].alias("min_score"), m["hi"].alias("max_score"),
    )
    return drift.score_drift(summary, F.lit(baseline_mean), F.lit(baseline_std))
