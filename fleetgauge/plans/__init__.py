"""The diagnostic reports.

Every report is ``report(tables, **params) -> DataFrame``: ``tables`` maps the
table names of :mod:`fleetgauge.sources.schemas` to frames, and the result is
computed per ``(server_name, collected_at)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.plans import activity, cpu, index, io, waits
from fleetgauge.sources.buckets import LAYOUT, bucketed_session, read_bucketed
from fleetgauge.sources.rollups import HOURLY, read_hourly
from fleetgauge.sources.snapshots import LISTED_POLLS, read_tables, with_filters, written_parts


@dataclass(frozen=True)
class Report:
    """A report function, the tables it reads, and those of them that a range of dates leaves whole.

    Session history is stored by the day of the poll, the jobs it is labelled
    with by the day of the capture.
    """

    run: Callable[..., DataFrame]
    tables: tuple[str, ...]
    undated: tuple[str, ...] = ()


_STATEMENTS = ("query_stats", "sql_text", "databases", "objects")
_ACTIVITY = ("activity", "jobs")

REPORTS = {
    entry.run.__name__: entry
    for entry in (
        # processors, statements, sessions
        Report(cpu.log_search, ("error_log",)),
        Report(cpu.scheduler_count_by_node, ("schedulers",)),
        Report(cpu.scheduler_load, ("schedulers",)),
        Report(cpu.cpu_history, ("ring_buffer", "sys_info")),
        Report(cpu.cpu_by_database, ("query_stats", "plan_attributes", "databases")),
        Report(cpu.top_queries_by_worker_time, ("query_stats", "sql_text", "databases")),
        Report(cpu.top_queries_by_total_cpu, _STATEMENTS),
        Report(cpu.top_queries_by_avg_cpu, _STATEMENTS),
        Report(cpu.top_procedures, ("proc_stats", "procedures", "databases")),
        Report(cpu.active_requests, ("requests", "sessions", "sql_text", "query_plan", "databases")),
        Report(cpu.head_blockers, ("processes", "requests", "sql_text", "databases")),
        # storage
        Report(io.log_segment_count, ("log_segments", "databases")),
        Report(io.drive_latency, ("file_io", "files", "volumes")),
        Report(io.io_stalls_by_file, ("file_io", "files", "databases")),
        Report(io.io_by_database, ("file_io", "databases")),
        Report(io.io_warnings, ("error_log",)),
        Report(io.volume_space, ("files", "volumes")),
        Report(io.top_statements_by_avg_io, _STATEMENTS),
        Report(io.io_profile_by_file, ("file_io", "db_files", "databases")),
        # session activity
        Report(activity.activity_latest, _ACTIVITY, ("jobs",)),
        Report(activity.activity_io_offenders, _ACTIVITY, ("jobs",)),
        Report(activity.activity_blocking, _ACTIVITY, ("jobs",)),
        Report(activity.blocked_per_hour, _ACTIVITY, ("jobs",)),
        Report(activity.blocking_per_hour, _ACTIVITY, ("jobs",)),
        Report(activity.sessions_per_program, _ACTIVITY, ("jobs",)),
        # indexes
        Report(index.missing_indexes, ("mi_group_stats", "mi_groups", "mi_details")),
        Report(index.unused_indexes, ("databases", "indexes", "objects", "index_usage", "partition_stats")),
        Report(
            index.index_profile,
            (
                "index_usage",
                "databases",
                "objects",
                "indexes",
                "index_operational",
                "index_physical",
                "partition_stats",
            ),
        ),
        # waits
        Report(waits.latch_pareto, ("latch_stats",)),
        Report(waits.wait_pareto, ("wait_stats",)),
    )
}


def report(name: str, tables: Mapping[str, DataFrame], **params) -> DataFrame:
    """Run one report over given tables."""
    return REPORTS[name].run(tables, **params)


def report_over(
    spark: SparkSession,
    root: str,
    name: str,
    first_date=None,
    last_date=None,
    servers=None,
    buckets=None,
    rollups=False,
    listed=False,
    **params,
) -> DataFrame:
    """Run one report over the snapshot tables stored under ``root``.

    Dates are those of the capture, for session history those of the poll.
    With ``buckets``, tables that :func:`fleetgauge.sources.buckets.write_bucketed`
    stored in so many are read from there.  With ``rollups``, counts of the
    session history come from :func:`fleetgauge.sources.rollups.roll_up` where
    those are up to date.  With ``listed``, the newest poll is looked for on the
    last day that :func:`fleetgauge.sources.snapshots.write_table` listed for
    each snapshot; rows that something else wrote are not found that way.
    """
    wanted = REPORTS[name].tables
    by_bucket = [t for t in wanted if buckets and t in LAYOUT]
    if by_bucket:
        spark = bucketed_session(spark)
    tables = read_tables(
        spark, root, [t for t in wanted if t not in by_bucket], first_date, last_date, servers, undated=REPORTS[name].undated
    )
    tables |= read_bucketed(spark, root, by_bucket, first_date, last_date, servers, buckets)
    if rollups and "activity" in wanted:
        # The same rows as of the history, or no day would add up.
        tables[HOURLY] = with_filters(read_hourly(spark, root), first_date, last_date, servers)
    if listed and "activity" in wanted:
        tables[LISTED_POLLS] = with_filters(written_parts(spark, root, "activity"), first_date, last_date, servers)
    return report(name, tables, **params)
