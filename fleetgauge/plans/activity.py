"""Polled session activity: newest poll, I/O offenders, blocking over time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.clock import hour_bucket
from fleetgauge.functions.text import literal
from fleetgauge.operators.lookup import at_latest, with_program_label
from fleetgauge.operators.ranking import ordering, sort_filtered
from fleetgauge.sources.rollups import COUNTED, HOURLY
from fleetgauge.sources.schemas import KEYS, PARTITION
from fleetgauge.sources.snapshots import LISTED_POLLS, dated

Moment = str | dt.datetime

# What tells two rows of the history apart.
_ROW = ["collection_time", "session_id", "start_time"]
_DURATION = "`dd hh:mm:ss.mss` AS duration"
_IS_BLOCKED = COUNTED["blocked_count"]
_IS_BLOCKING = COUNTED["blocking_count"]


def _between(activity: DataFrame, start: Moment, end: Moment) -> DataFrame:
    """Polls from ``start`` to ``end``, both included.

    The history is partitioned by the date of the poll, so the same range on
    dates keeps other days' files closed.
    """
    activity = dated(activity, "collection_time")
    low, high = (f"CAST({literal(str(t))} AS TIMESTAMP_NTZ)" for t in (start, end))
    return activity.where(
        f"{PARTITION} BETWEEN CAST({low} AS DATE) AND CAST({high} AS DATE) AND collection_time BETWEEN {low} AND {high}"
    )


def _sessions(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Session lines with resolved program labels, by start time."""
    lines = with_program_label(rows, jobs, _ROW).selectExpr(
        *KEYS,
        "start_time",
        "collection_time",
        _DURATION,
        "session_id",
        "blocking_session_id",
        "blocking_session_count",
        "cpu",
        "used_memory",
        "reads",
        "writes",
        "login_name",
        "database_name",
        "program_label AS program_name",
        "host_name",
        "wait_info",
        "sql_text",
        "sql_command",
    )
    return sort_filtered(lines, _ROW, *KEYS, "start_time", "collection_time", "session_id")


def activity_latest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Sessions of the newest poll."""
    rows = dated(tables["activity"], "collection_time")
    return _sessions(at_latest(rows, "collection_time", tables.get(LISTED_POLLS)), tables["jobs"])


def activity_blocking(tables: Mapping[str, DataFrame], start: Moment, end: Moment) -> DataFrame:
    """Sessions that were blocked or blocked others."""
    rows = _between(tables["activity"], start, end).where(f"{_IS_BLOCKED} OR {_IS_BLOCKING}")
    return _sessions(rows, tables["jobs"])


def activity_io_offenders(tables: Mapping[str, DataFrame], start: Moment, end: Moment) -> DataFrame:
    """Sessions by writes plus physical reads."""
    rows = _between(tables["activity"], start, end).selectExpr(
        "*", "writes + physical_reads AS total_io"
    )
    labelled = with_program_label(rows, tables["jobs"], _ROW)
    # Nothing but the range filters these rows, so the widest table is not shuffled before its sort.
    return labelled.orderBy(*KEYS, *ordering(["total_io"], _ROW)).selectExpr(
        *KEYS,
        "start_time",
        _DURATION,
        "writes",
        "physical_reads",
        "database_name",
        "program_label AS program_name",
        "host_name",
        "wait_info",
        "sql_text",
        "sql_command",
    )


def _whole_days(start: Moment, end: Moment) -> str:
    """Predicate on the partition column: days of which the range leaves nothing out."""
    low, high = (f"CAST({literal(str(t))} AS TIMESTAMP_NTZ)" for t in (start, end))
    first, last = f"CAST({low} AS DATE)", f"CAST({high} AS DATE)"
    later = f"IF({low} > CAST({first} AS TIMESTAMP_NTZ), 1, 0)"
    earlier = f"IF({high} < CAST(date_add({last}, 1) AS TIMESTAMP_NTZ) - INTERVAL '0.000001' SECOND, 1, 0)"
    return f"{PARTITION} BETWEEN date_add({first}, {later}) AND date_sub({last}, {earlier})"


def _counts(tables: Mapping[str, DataFrame], start: Moment, end: Moment, name: str, by: str) -> DataFrame:
    """``name``: sessions per raw program name and ``by``, hour or host.

    With stored counts, whole days come from those.  Read from the rows are the
    cut days at both ends and days whose counts and rows differ in number,
    which row counts in file footers tell.
    """
    key = by.split()[-1]

    def counted(rows: DataFrame) -> DataFrame:
        narrow = rows.where(COUNTED[name]).selectExpr(*KEYS, by, "program_name")
        return narrow.groupBy(*KEYS, key, "program_name").agg(F.expr("count(*) AS n"))

    rows = _between(tables["activity"], start, end)
    if HOURLY not in tables:
        return counted(rows)
    whole = _whole_days(start, end)
    hourly = tables[HOURLY].where(whole)
    stored = dated(tables["activity"], "collection_time").where(whole).groupBy(PARTITION).agg(F.expr("count(*) AS stored"))
    known = hourly.groupBy(PARTITION).agg(F.expr("sum(session_count) AS known"))
    # One row for each day at most, so it can always be broadcast; it prunes the days of the rows.
    stale = F.broadcast(stored.join(known, PARTITION, "left").where("stored IS DISTINCT FROM known").select(PARTITION))
    ready = hourly.join(stale, PARTITION, "left_anti").where(f"{name} > 0")
    return (
        ready.selectExpr(*KEYS, by.replace("collection_time", "hour"), "program_name", f"{name} AS n")
        .union(counted(rows.where(whole).join(stale, PARTITION, "left_semi")))
        .union(counted(rows.where(f"NOT ({whole})")))
    )


def _by_program(counts: DataFrame, jobs: DataFrame, by: str, name: str) -> DataFrame:
    """Counts per program label and ``by``.

    Counted per raw program name first, so labels are resolved for a handful
    of programs instead of for every session, and a busy program costs one row
    per task.
    """
    labelled = with_program_label(counts, jobs, [by, "program_name"])
    return labelled.groupBy(*KEYS, by, F.col("program_label").alias("program")).agg(F.sum("n").alias(name))


def _per_hour(tables: Mapping[str, DataFrame], start: Moment, end: Moment, name: str) -> DataFrame:
    counts = _counts(tables, start, end, name, f"{hour_bucket('collection_time')} AS hour")
    return _by_program(counts, tables["jobs"], "hour", name).orderBy(*KEYS, "hour", F.desc(name), "program")


def blocked_per_hour(tables: Mapping[str, DataFrame], start: Moment, end: Moment) -> DataFrame:
    """Blocked sessions per hour and program."""
    return _per_hour(tables, start, end, "blocked_count")


def blocking_per_hour(tables: Mapping[str, DataFrame], start: Moment, end: Moment) -> DataFrame:
    """Blocking sessions per hour and program."""
    return _per_hour(tables, start, end, "blocking_count")


def sessions_per_program(tables: Mapping[str, DataFrame], start: Moment, end: Moment) -> DataFrame:
    """Session rows per program and host."""
    counts = _counts(tables, start, end, "session_count", "host_name")
    return _by_program(counts, tables["jobs"], "host_name", "session_count").orderBy(*KEYS, "program", "host_name")
