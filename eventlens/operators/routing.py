"""Which channel hears of which incident, what it is sent, and what became of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventlens.config import SEVERITY_CHANNELS
from eventlens.functions import render
from eventlens.schema import JSON_TEXT

DELIVERY_SCHEMA = "incident_id string, channel string, page long, status string, error string"


def route(
    incidents: DataFrame,
    configured: Sequence[str],
    channels: Mapping[str, Sequence[str]] | None = SEVERITY_CHANNELS,
) -> DataFrame:
    """(incident columns, channel): one row per incident and channel of its severity.

    ``channels=None`` sends to all configured channels. A severity without an entry goes nowhere;
    channels that are not configured drop out.
    """
    if channels is None:
        wanted = F.array(*[F.lit(c) for c in configured]).cast("array<string>")
    else:
        wanted = F.array().cast("array<string>")
        for severity, names in channels.items():
            known = F.array(*[F.lit(c) for c in names if c in configured]).cast("array<string>")
            wanted = F.when(F.col("severity") == severity, known).otherwise(wanted)
    return incidents.withColumn("channel", F.explode(wanted))


def details(incidents: DataFrame) -> Column:
    """What the messages show below the description."""
    return F.struct(*[c for c in ("page", "pages", "events", "model_info", "max_score", "event_count") if c in incidents.columns])


def with_payload(routed: DataFrame) -> DataFrame:
    """Adds ``subject`` and ``body`` for the row's channel: HTML, message blocks or the incident as JSON."""
    fields = [F.col(c) for c in ("title", "severity", "timestamp", "description")]
    shown = details(routed)
    whole = F.to_json(F.struct("id", "title", "severity", "timestamp", "description", shown.alias("details")), JSON_TEXT)
    body = (
        F.when(F.col("channel") == "email", render.email_body(*fields, shown))
        .when(F.col("channel") == "slack", render.chat_blocks(*fields, shown))
        .when(F.col("channel") == "webhook", whole)
    )
    return routed.withColumns({"subject": render.subject(F.col("title")), "body": body})


def with_event_pages(incidents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per incident and page of its events, with the page's number and how many there are; messages go out page by page."""
    numbers = pages.groupBy(F.col("incident_id").alias("id")).agg(F.count(F.lit(1)).alias("pages"))
    return incidents.join(pages.withColumnRenamed("incident_id", "id"), "id").join(numbers, "id")


def record_only(incident_id: str, channel: str, page: int | None, body: str) -> None:
    """Stands in for a sender: delivers nothing, but an empty body is an error."""
    if not body:
        raise ValueError("nothing to send")


def deliver(messages: DataFrame, send: Callable[[str, str, int | None, str], None] = record_only) -> DataFrame:
    """(incident_id, channel, page, status, error): calls ``send(id, channel, page, body)`` per row on the executors.

    ``page`` is null where messages carry no pages. A failed call is logged and the rest goes on. A
    repeated task sends again, so receivers should drop repeats by incident id and page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            log = []
            for one in pdf.itertuples(index=False):
                page = None if pd.isna(one.page) else int(one.page)
                try:
                    send(one.id, one.channel, page, one.body)
                    log.append((one.id, one.channel, page, "sent", None))
                except Exception as error:  # the log keeps whatever the sender raised
                    log.append((one.id, one.channel, page, "failed", str(error)))
            yield pd.DataFrame(log, columns=["incident_id", "channel", "page", "status", "error"]).astype({"page": "Int64"})

    page = F.col("page") if "page" in messages.columns else F.lit(None)
    return messages.select("id", "channel", page.cast("bigint").alias("page"), "body").mapInPandas(run, DELIVERY_SCHEMA)
