"""How often the headline plans read the events, and how often they shuffle, before anything runs."""

import re

import pytest
from helpers import SF

import __spark_entry__ as entry

# name: scans of the events table, exchanges
LIMITS = {
    "features_all": (2, 20),  # and one more scan, whose counts are a table when this plan starts
    "feature_matrix": (2, 4),
    "family_windows": (2, 5),
    "family_windows_rolled_up": (2, 6),
    "event_transitions": (1, 5),  # three for the counts, two for their entropies
    "time_gaps": (1, 3),
}


@pytest.mark.parametrize("name", LIMITS)
def test_scans_and_exchanges(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = len(re.findall(r"FileScan parquet \[[^\n]*events\.parquet", plan))
    exchanges = len(re.findall(r"Exchange (?:hash|range|single)", plan, re.IGNORECASE))
    most_scans, most_exchanges = LIMITS[name]
    assert scans <= most_scans and exchanges <= most_exchanges, (scans, exchanges, plan)
