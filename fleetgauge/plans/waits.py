"""Where wait time concentrates: latches and waits up to 95 percent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from fleetgauge.functions.arithmetic import half_up_ratio, percent_of
from fleetgauge.functions.text import literal, one_of
from fleetgauge.operators.ranking import pareto_prefix
from fleetgauge.sources.schemas import KEYS

# Wait types that mean "nothing to do" and are left out, by
# group.  The mirroring and availability groups may be put back for servers
# that have trouble there.
BENIGN_WAITS = {
    "background": (
        "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH",
        "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT",
        "CLR_SEMAPHORE", "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE", "EXECSYNC", "FSAGENT",
        "FT_IFTS_SCHEDULER_IDLE_WAIT", "FT_IFTSHC_MUTEX", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP",
        "LOGMGR_QUEUE", "MEMORY_ALLOCATION_EXT", "ONDEMAND_TASK_QUEUE", "PREEMPTIVE_XE_GETTARGETSTATE",
        "PWAIT_ALL_COMPONENTS_INITIALIZED", "PWAIT_DIRECTLOGCONSUMER_GETNEXT", "QDS_ASYNC_QUEUE",
        "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
        "QDS_SHUTDOWN_QUEUE", "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE",
        "SERVER_IDLE_CHECK", "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP",
        "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP",
        "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT",
        "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
        "SQLTRACE_WAIT_ENTRIES", "WAIT_FOR_RESULTS", "WAITFOR", "WAITFOR_TASKSHUTDOWN",
        "WAIT_XTP_RECOVERY", "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "WAIT_XTP_CKPT_CLOSE",
        "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
    ),
    "mirroring": (
        "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE", "DBMIRRORING_CMD",
    ),
    "availability": (
        "HADR_CLUSAPI_CALL", "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT",
        "HADR_NOTIFICATION_DEQUEUE", "HADR_TIMER_TASK", "HADR_WORK_QUEUE",
    ),
}
# Latch class left out, page of the help text, share to reach.
BENIGN_LATCHES = ("BUFFER",)
HELP_URL = "https://www.sqlskills.com/help/waits/"
THRESHOLD = 95


def benign_waits(groups: Sequence[str] = tuple(BENIGN_WAITS)) -> list[str]:
    """Wait types of the given groups."""
    return [name for group in groups for name in BENIGN_WAITS[group]]


def latch_pareto(
    tables: Mapping[str, DataFrame],
    ignore: Sequence[str] = BENIGN_LATCHES,
    threshold: float = THRESHOLD,
    strategy: str = "bucketed",
) -> DataFrame:
    """Latch classes that make up most of the latch wait time."""
    latches = (
        tables["latch_stats"]
        .where(f"wait_time_ms > 0 AND NOT {one_of('latch_class', ignore)}")
        .select(*KEYS, "latch_class", "waiting_requests_count", "wait_time_ms")
    )
    return (
        pareto_prefix(latches, "wait_time_ms", ["latch_class"], threshold, strategy=strategy)
        .orderBy(*KEYS, "row_rank")
        .selectExpr(
            *KEYS,
            "row_rank",
            "latch_class",
            f"{half_up_ratio('wait_time_ms', 1000, 2)} AS wait_s",
            "waiting_requests_count AS wait_count",
            f"{percent_of('wait_time_ms', 'group_sum', 2)} AS percentage",
            f"{half_up_ratio('wait_time_ms', 'waiting_requests_count * 1000', 4)} AS avg_wait_s",
        )
    )


def wait_pareto(
    tables: Mapping[str, DataFrame],
    ignore: Sequence[str] | None = None,
    threshold: float = THRESHOLD,
    strategy: str = "bucketed",
) -> DataFrame:
    """Wait types that make up most of the wait time, split into resource and signal."""
    ignore = benign_waits() if ignore is None else ignore
    waits = (
        tables["wait_stats"]
        .where(f"waiting_tasks_count > 0 AND NOT {one_of('wait_type', ignore)}")
        .select(*KEYS, "wait_type", "waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms")
    )
    resource, per_task = "wait_time_ms - signal_wait_time_ms", "waiting_tasks_count * 1000"
    return (
        pareto_prefix(waits, "wait_time_ms", ["wait_type"], threshold, strategy=strategy)
        .orderBy(*KEYS, "row_rank")
        .selectExpr(
            *KEYS,
            "row_rank",
            "wait_type",
            f"{half_up_ratio('wait_time_ms', 1000, 2)} AS wait_s",
            f"{half_up_ratio(resource, 1000, 2)} AS resource_s",
            f"{half_up_ratio('signal_wait_time_ms', 1000, 2)} AS signal_s",
            "waiting_tasks_count AS wait_count",
            f"{percent_of('wait_time_ms', 'group_sum', 2)} AS percentage",
            f"{half_up_ratio('wait_time_ms', per_task, 4)} AS avg_wait_s",
            f"{half_up_ratio(resource, per_task, 4)} AS avg_resource_s",
            f"{half_up_ratio('signal_wait_time_ms', per_task, 4)} AS avg_signal_s",
            f"concat({literal(HELP_URL)}, wait_type) AS help_url",
        )
    )
