"""Processors: schedulers, CPU history, expensive statements and procedures, live sessions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.arithmetic import int_avg, int_div
from fleetgauge.functions.clock import boundary_diff, duration_text, minus_millis
from fleetgauge.functions.text import contains_all, literal, one_of, statement_slice
from fleetgauge.operators.lookup import in_databases, left_join_sparse, with_database_name, with_object_name
from fleetgauge.operators.prefilter import may_be_among
from fleetgauge.operators.ranking import ordering, share_rank, sort_filtered, top_k
from fleetgauge.sources.schemas import KEYS

# Fixed values of the captured views.
ONLINE_SCHEDULER = "VISIBLE ONLINE"
MONITOR_RECORD = "RING_BUFFER_SCHEDULER_MONITOR"
HEALTH_MARKER = "<SystemHealth>"
DATABASE_ATTRIBUTE = "dbid"
RESOURCE_DATABASE_ID = 32767
CORE_COUNT_TERMS = ("detected", "socket")

_MONITOR_SCHEMA = (
    "_id INT, SchedulerMonitorEvent STRUCT<SystemHealth: STRUCT<SystemIdle: INT, ProcessUtilization: INT>>"
)
# What tells two rows of query_stats in one snapshot apart.
STATEMENT_ID = ["plan_handle", "sql_handle", "statement_start_offset", "statement_end_offset"]
def search_log(
    tables: Mapping[str, DataFrame], terms: Sequence[str], generations: Sequence[int], newest_first: bool
) -> DataFrame:
    """Lines of the given log generations that hold every term, by time.

    Lines of the same time go by process and by a hash of their text: sort keys
    are sampled to the driver, and a line can be of any length.
    """
    lines = (
        tables["error_log"]
        .where(f"{one_of('log_generation', generations)} AND {contains_all('log_text', terms)}")
        .select(*KEYS, "log_date", "process_info", "log_text")
    )
    time = F.desc("log_date") if newest_first else F.asc("log_date")
    text = F.xxhash64("log_text")
    return sort_filtered(lines, [*KEYS, "log_date", text], *KEYS, time, "process_info", text)


def log_search(
    tables: Mapping[str, DataFrame],
    terms: Sequence[str] = CORE_COUNT_TERMS,
    generations: Sequence[int] = (0,),
) -> DataFrame:
    """Log lines that hold every term; the default finds the core counts."""
    return search_log(tables, terms, generations, newest_first=False)


def scheduler_count_by_node(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Online schedulers per node."""
    return (
        tables["schedulers"]
        .where(f"status = {literal(ONLINE_SCHEDULER)}")
        .groupBy(*KEYS, "parent_node_id")
        .agg(F.expr("count(*) AS scheduler_count"))
        .orderBy(*KEYS, "parent_node_id")
    )


def scheduler_load(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tasks, workers and average load factor per scheduler status."""
    return (
        tables["schedulers"]
        .groupBy(*KEYS, "status")
        .agg(
            F.expr("count(*) AS scheduler_count"),
            F.expr("sum(current_tasks_count) AS current_tasks_count"),
            F.expr("sum(runnable_tasks_count) AS runnable_tasks_count"),
            F.expr("sum(active_workers_count) AS active_workers_count"),
            F.expr(f"{int_avg('load_factor')} AS load_factor"),
        )
        .orderBy(*KEYS, "status")
    )


def cpu_history(tables: Mapping[str, DataFrame], k: int = 256) -> DataFrame:
    """Newest ``k`` samples of server, idle and other CPU use.

    The marker is tested on the raw text, ahead of parsing.  Missing nodes and
    malformed records read as NULL.
    """
    health = "event.SchedulerMonitorEvent.SystemHealth"
    samples = (
        tables["ring_buffer"]
        .where(f"ring_buffer_type = {literal(MONITOR_RECORD)} AND contains(record, {literal(HEALTH_MARKER)})")
        .selectExpr(*KEYS, "timestamp AS ticks", f"from_xml(record, '{_MONITOR_SCHEMA}') AS event")
        .selectExpr(
            *KEYS,
            "ticks",
            "event._id AS record_id",
            f"{health}.ProcessUtilization AS process_cpu",
            f"{health}.SystemIdle AS system_idle",
        )
    )
    newest = top_k(samples, ["record_id"], ["ticks"], k)
    # The number of CPU ticks per millisecond is itself truncated.
    now = tables["sys_info"].selectExpr(
        *KEYS, f"{int_div('cpu_ticks', int_div('cpu_ticks', 'ms_ticks'))} AS now_ticks"
    )
    return (
        newest.join(now, KEYS, "left")
        .orderBy(*KEYS, F.desc("record_id"), "ticks")
        .selectExpr(
            *KEYS,
            "process_cpu",
            "system_idle",
            "100 - system_idle - process_cpu AS other_cpu",
            f"{minus_millis('collected_at', 'now_ticks - ticks')} AS event_time",
        )
    )


def cpu_by_database(tables: Mapping[str, DataFrame], strategy: str = "plain") -> DataFrame:
    """CPU time per database, its rank and share.

    A server numbers at most 32,767 databases, so after the aggregation a
    snapshot is small enough to rank in one task.
    """
    # Statements of one plan are summed first: the join then sees a plan once.
    by_plan = (
        tables["query_stats"]
        .groupBy(*KEYS, "plan_handle")
        .agg(F.expr(f"sum({int_div('total_worker_time', 1000)}) AS cpu_ms"))
    )
    plan_database = (
        tables["plan_attributes"]
        .where(f"attribute = {literal(DATABASE_ATTRIBUTE)}")
        .selectExpr(*KEYS, "plan_handle", "try_cast(value AS BIGINT) AS database_id")
        # An id that cannot be read is a line without a name: its time counts in the shares.
        .where(f"database_id IS DISTINCT FROM {RESOURCE_DATABASE_ID}")
    )
    by_database = (
        by_plan.join(plan_database, [*KEYS, "plan_handle"])
        .groupBy(*KEYS, "database_id")
        .agg(F.sum("cpu_ms").alias("cpu_time_ms"))
    )
    ranked = share_rank(by_database, "cpu_time_ms", ["database_id"], strategy=strategy)
    return (
        with_database_name(ranked, tables["databases"])
        .selectExpr(*KEYS, "row_rank AS cpu_rank", "database_name", "cpu_time_ms", "share AS cpu_percent")
        .orderBy(*KEYS, "cpu_rank")
    )


def per_execution(total: str) -> str:
    """Truncated average per execution; NULL for a statement that never ended."""
    return int_div(total, "execution_count")


def text_owners(tables: Mapping[str, DataFrame], handle: str) -> DataFrame:
    """Database and object of every known text, without the text."""
    return tables["sql_text"].selectExpr(*KEYS, f"handle AS {handle}", "dbid", "objectid")


def texts(tables: Mapping[str, DataFrame], handle: str) -> DataFrame:
    """Text of every handle."""
    return tables["sql_text"].selectExpr(*KEYS, f"handle AS {handle}", "text")


def texts_of(tables: Mapping[str, DataFrame], winners: DataFrame, handle: str) -> DataFrame:
    """Text of every handle that ``winners`` have, and of few others."""
    return may_be_among(texts(tables, handle), winners, [*KEYS, handle])


def top_queries_by_worker_time(tables: Mapping[str, DataFrame], k: int = 50) -> DataFrame:
    """Statements with the most worker time.

    Ranking runs on counters only; the texts of the ``k`` winners are picked out where they are scanned.
    """
    measures = [
        "total_worker_time",
        "min_worker_time",
        "max_worker_time",
        "total_elapsed_time",
        "min_elapsed_time",
        "max_elapsed_time",
        "total_logical_reads",
        "min_logical_reads",
        "max_logical_reads",
        "execution_count",
        "creation_time",
    ]
    stats = tables["query_stats"].select(*KEYS, *STATEMENT_ID, *measures)
    owned = stats.join(text_owners(tables, "plan_handle").drop("objectid"), [*KEYS, "plan_handle"])
    winners = top_k(owned, ["total_worker_time"], STATEMENT_ID, k)
    named = with_database_name(winners, tables["databases"], "dbid")
    return (
        named.join(texts_of(tables, winners, "plan_handle"), [*KEYS, "plan_handle"])
        .orderBy(*KEYS, *ordering(["total_worker_time"], STATEMENT_ID))
        .selectExpr(
            *KEYS,
            "database_name",
            "text AS query_text",
            "total_worker_time",
            "min_worker_time",
            f"{per_execution('total_worker_time')} AS avg_worker_time",
            "max_worker_time",
            "min_elapsed_time",
            f"{per_execution('total_elapsed_time')} AS avg_elapsed_time",
            "max_elapsed_time",
            "min_logical_reads",
            f"{per_execution('total_logical_reads')} AS avg_logical_reads",
            "max_logical_reads",
            "execution_count",
            "creation_time",
        )
    )


def top_queries_by_total_cpu(tables: Mapping[str, DataFrame], k: int = 50) -> DataFrame:
    """Statements with the most CPU time overall, with the object they belong to."""
    return _top_queries_by_cpu(tables, "total_cpu_time", k)


def top_queries_by_avg_cpu(tables: Mapping[str, DataFrame], k: int = 50) -> DataFrame:
    """Statements with the most CPU time per execution."""
    return _top_queries_by_cpu(tables, "average_cpu_time", k)


def _top_queries_by_cpu(tables: Mapping[str, DataFrame], by: str, k: int) -> DataFrame:
    stats = tables["query_stats"].selectExpr(
        *KEYS,
        *STATEMENT_ID,
        "total_physical_reads",
        "total_logical_reads",
        "execution_count",
        "total_worker_time AS total_cpu_time",
        f"{per_execution('total_worker_time')} AS average_cpu_time",
        "total_elapsed_time",
        "max_logical_writes",
        "creation_time",
        "last_execution_time",
    )
    winners = top_k(
        stats.join(text_owners(tables, "sql_handle"), [*KEYS, "sql_handle"]), [by], STATEMENT_ID, k
    )
    named = with_object_name(
        with_database_name(winners, tables["databases"], "dbid"), tables["objects"]
    )
    return (
        named.join(texts_of(tables, winners, "sql_handle"), [*KEYS, "sql_handle"])
        .orderBy(*KEYS, *ordering([by], STATEMENT_ID))
        .selectExpr(
            *KEYS,
            "concat(schema_name, '.', bare_name) AS object_name",
            "text AS text_data",
            "total_physical_reads AS disk_reads",
            "total_logical_reads AS memory_reads",
            "execution_count AS executions",
            "total_cpu_time",
            "average_cpu_time",
            "total_elapsed_time AS disk_wait_and_cpu_time",
            "max_logical_writes AS memory_writes",
            "creation_time AS date_cached",
            "database_name",
            "last_execution_time",
        )
    )


# Per metric: what is summed up, further sort columns, whether rows without
# any are left out, and how calls per minute treat procedures cached for less
# than a minute ("null", "zero", or None for no such column).
_PROCEDURE_METRICS = {
    "worker_time": ("total_worker_time", [], False, "null"),
    "logical_reads": ("total_logical_reads", [], False, "zero"),
    "logical_writes": ("total_logical_writes", [], True, "zero"),
    "physical_reads": ("total_physical_reads", ["total_logical_reads"], True, None),
}


def top_procedures(
    tables: Mapping[str, DataFrame],
    metric: str = "worker_time",
    database: str | None = None,
    k: int = 25,
) -> DataFrame:
    """Cached procedures of a database by one cost metric.

    ``metric`` is worker_time, logical_reads, logical_writes or physical_reads.
    Without a ``database`` every database gets its own top ``k``.
    """
    total, more, only_positive, calls = _PROCEDURE_METRICS[metric]
    stats = tables["proc_stats"]
    if only_positive:
        stats = stats.where(f"{total} > 0")
    names = tables["procedures"].selectExpr(*KEYS, "database_id", "object_id", "name AS sp_name")
    procedures = in_databases(
        stats.join(names, [*KEYS, "database_id", "object_id"]), tables["databases"], database
    )
    by, entity = [total, *more], ["object_id", "cached_time"]
    winners = top_k(procedures, by, entity, k, group=[*KEYS, "database_id"])

    minutes = boundary_diff("minute", "cached_time", "collected_at")
    rate = f"coalesce({int_div('execution_count', minutes)}, 0)"
    calls_per_minute = {
        "null": [f"CASE WHEN {minutes} > 0 THEN {rate} END AS calls_per_minute"],
        "zero": [f"{rate} AS calls_per_minute"],
        None: [],
    }[calls]
    return winners.orderBy(*KEYS, "database_id", *ordering(by, entity)).selectExpr(
        *KEYS,
        "database_name",
        "sp_name",
        total,
        f"{per_execution(total)} AS {total.replace('total', 'avg')}",
        "execution_count",
        *calls_per_minute,
        *more,
        "total_elapsed_time",
        f"{per_execution('total_elapsed_time')} AS avg_elapsed_time",
        "cached_time",
    )


def active_requests(tables: Mapping[str, DataFrame], exclude_sessions: Iterable[int] = ()) -> DataFrame:
    """Requests running now, but for the collector's own sessions."""
    sessions = tables["sessions"].select(*KEYS, "session_id", "host_name", "program_name")
    plans = tables["query_plan"].select(*KEYS, "plan_handle", "query_plan")
    joined = (
        tables["requests"]
        .where(f"NOT {one_of('session_id', exclude_sessions)}")
        .join(sessions, [*KEYS, "session_id"])
        .join(texts(tables, "sql_handle"), [*KEYS, "sql_handle"])
    )
    # Requests that are still being compiled have no plan.
    joined = left_join_sparse(joined, plans, "plan_handle", ["session_id", "start_time"])
    statement = statement_slice("text", "statement_start_offset", "statement_end_offset", "exact")
    row = ["start_time", "session_id"]
    # Sorted behind an exchange: the sort's sample would otherwise run all joins a second time.
    return sort_filtered(with_database_name(joined, tables["databases"]), row, *KEYS, *row).selectExpr(
        *KEYS,
        "session_id",
        "text AS text_command",
        "database_name",
        "host_name",
        "program_name",
        "status",
        "command",
        "cpu_time",
        "reads",
        "writes",
        f"{duration_text('start_time', 'collected_at')} AS duration",
        "start_time",
        "blocking_session_id",
        "wait_type",
        "wait_time",
        "last_wait_type",
        f"concat('<?query --', char(13), {statement}, char(13), '--?>') AS sql_statement",
        "query_plan",
    )


def head_blockers(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Sessions that block others and are not blocked themselves."""
    processes = tables["processes"]
    # A blocker is listed once, however many sessions wait for it.
    blockers = processes.selectExpr(*KEYS, "blocked AS spid").distinct()
    heads = with_database_name(
        processes.where("blocked = 0").join(blockers, [*KEYS, "spid"], "left_semi"),
        tables["databases"],
        "dbid",
    )
    requests = tables["requests"].selectExpr(
        *KEYS,
        "session_id AS spid",
        "statement_start_offset",
        "statement_end_offset",
        "sql_handle",
    )
    statement = statement_slice("text", "statement_start_offset", "statement_end_offset", "legacy")
    # A head blocker without a request has no statement.
    return (
        left_join_sparse(heads.join(requests, [*KEYS, "spid"], "left"), texts(tables, "sql_handle"), "sql_handle", ["spid"])
        .selectExpr(
            *KEYS,
            "spid",
            "status",
            "left(loginame, 12) AS loginame",
            "left(hostname, 12) AS hostname",
            "rpad(CAST(blocked AS STRING), 3, ' ') AS blk",
            "open_tran",
            "left(database_name, 10) AS dbname",
            "cmd",
            "waittype",
            "waittime",
            "last_batch",
            f"{statement} AS sql_statement",
        )
    )
