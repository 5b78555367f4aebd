"""Small frames and plain-Python definitions to compare with."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime, timedelta

from eventlens.schema import EVENT_SCHEMA, complete

START = datetime(2024, 1, 1)

SF = "/root/testdata/sf0.001"


def frame(spark, rows: list[dict]):
    """Event rows; missing fields are null, ``timestamp`` may be given in seconds from the start."""
    full = []
    for i, row in enumerate(rows):
        at = row.get("timestamp", i)
        at = START + timedelta(seconds=at) if isinstance(at, (int, float)) else at
        full.append({"event_id": i, "event_type": "x", **row, "timestamp": at})
    return spark.createDataFrame([tuple(r.get(n) for n in EVENT_SCHEMA.names) for r in full], EVENT_SCHEMA)


def features_of(long) -> dict:
    """feature -> value of a table with one scope."""
    rows = long.select("feature", "value").collect()
    assert len({r["feature"] for r in rows}) == len(rows)
    return {r["feature"]: r["value"] for r in rows}


def entropy(values, smoothing: float = 0.0) -> float:
    counts = Counter(values)
    total = sum(counts.values())
    return 0.0 - sum(n / total * math.log2(n / total + smoothing) for n in counts.values()) if total else 0.0


def sample_events(spark):
    """The events of the smallest test tables, without scores."""
    from checks.sample import events

    return complete(events(spark, SF))
