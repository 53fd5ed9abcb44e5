"""Hourly counts of the session history, kept beside it and merged when read.

A day's polls are counted by hour, raw program name and host; jobs are named
when a report reads the counts, so a job that is renamed needs no new counts.
Days are replaced whole.  A day whose counts no longer add up to its stored
rows is read from the rows instead, so late polls are never missed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fleetgauge.functions.clock import hour_bucket
from fleetgauge.sources.schemas import KEYS, PARTITION
from fleetgauge.sources.snapshots import read_optional, read_table, write_days

HOURLY = "activity_hourly"
# Count columns, and the sessions each of them counts.
COUNTED = {
    "session_count": "true",
    "blocked_count": "blocking_session_id IS NOT NULL",
    "blocking_count": "blocking_session_count <> 0",
}
_SCHEMA = (
    "server_name STRING, collected_at TIMESTAMP_NTZ, hour TIMESTAMP_NTZ, program_name STRING, host_name STRING, "
    f"{', '.join(f'{c} BIGINT' for c in COUNTED)}, {PARTITION} DATE"
)


def hourly_counts(activity: DataFrame) -> DataFrame:
    """Sessions per hour, raw program name and host; a busy program costs one row per task."""
    by = [*KEYS, "hour", "program_name", "host_name"]
    counts = [f"count_if({which}) AS {name}" for name, which in COUNTED.items()]
    hour = f"CAST(concat({hour_bucket('collection_time')}, ':00:00') AS TIMESTAMP_NTZ) AS hour"
    # Rows without a time belong to no hour and to no day that a range could name.
    polled = activity.where("collection_time IS NOT NULL")
    counted = polled.selectExpr(*KEYS, hour, "program_name", "host_name", "blocking_session_id", "blocking_session_count")
    grouped = counted.groupBy(*by).agg(*map(F.expr, counts))
    return grouped.selectExpr(*by, *COUNTED, f"CAST(hour AS DATE) AS {PARTITION}")


def roll_up(spark: SparkSession, root: str, first_date: dt.date | None = None, last_date: dt.date | None = None) -> None:
    """Count the days of the stored history, both dates inclusive, in place of what was counted before."""
    write_days(hourly_counts(read_table(spark, root, "activity", first_date, last_date)), f"{root}/{HOURLY}")


def read_hourly(spark: SparkSession, root: str) -> DataFrame:
    """Stored counts; empty where nothing was counted yet."""
    return read_optional(spark, f"{root}/{HOURLY}", StructType.fromDDL(_SCHEMA))
