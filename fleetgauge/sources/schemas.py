"""Schemas of the captured telemetry tables.

Every table is a set of snapshots: ``server_name`` and ``collected_at`` say
which server was read and when.  ``collected_date`` is the partition column:
the date of ``collected_at``, or of the poll (``collection_time``) in the
activity history, which one snapshot carries whole.
Times are TIMESTAMP_NTZ: servers report local wall-clock values without zone.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

KEYS = ["server_name", "collected_at"]
PARTITION = "collected_date"

_FLEET = "server_name STRING, collected_at TIMESTAMP_NTZ, collected_date DATE"

_COLUMNS = {
    # waits
    "wait_stats": "wait_type STRING, waiting_tasks_count BIGINT, wait_time_ms BIGINT, signal_wait_time_ms BIGINT",
    "latch_stats": "latch_class STRING, waiting_requests_count BIGINT, wait_time_ms BIGINT",
    # session activity
    "activity": (
        "collection_time TIMESTAMP_NTZ, start_time TIMESTAMP_NTZ, `dd hh:mm:ss.mss` STRING, session_id BIGINT, "
        "blocking_session_id BIGINT, blocking_session_count INT, cpu BIGINT, used_memory BIGINT, reads BIGINT, "
        "writes BIGINT, physical_reads BIGINT, login_name STRING, database_name STRING, program_name STRING, "
        "host_name STRING, wait_info STRING, sql_text STRING, sql_command STRING"
    ),
    "jobs": "job_id STRING, name STRING",
    # processors
    "schedulers": (
        "parent_node_id INT, status STRING, current_tasks_count INT, runnable_tasks_count INT, "
        "active_workers_count INT, load_factor INT"
    ),
    "sys_info": "cpu_ticks BIGINT, ms_ticks BIGINT",
    "ring_buffer": "ring_buffer_type STRING, `timestamp` BIGINT, record STRING",
    # statements, procedures, sessions
    "query_stats": (
        "sql_handle STRING, plan_handle STRING, statement_start_offset INT, statement_end_offset INT, "
        "execution_count BIGINT, total_worker_time BIGINT, min_worker_time BIGINT, max_worker_time BIGINT, "
        "total_elapsed_time BIGINT, min_elapsed_time BIGINT, max_elapsed_time BIGINT, total_logical_reads BIGINT, "
        "min_logical_reads BIGINT, max_logical_reads BIGINT, total_logical_writes BIGINT, max_logical_writes BIGINT, "
        "total_physical_reads BIGINT, creation_time TIMESTAMP_NTZ, last_execution_time TIMESTAMP_NTZ"
    ),
    "plan_attributes": "plan_handle STRING, attribute STRING, value STRING",
    "sql_text": "handle STRING, dbid BIGINT, objectid BIGINT, text STRING",
    "query_plan": "plan_handle STRING, query_plan STRING",
    "procedures": "database_id BIGINT, object_id BIGINT, name STRING",
    "proc_stats": (
        "database_id BIGINT, object_id BIGINT, cached_time TIMESTAMP_NTZ, execution_count BIGINT, "
        "total_worker_time BIGINT, total_elapsed_time BIGINT, total_logical_reads BIGINT, "
        "total_logical_writes BIGINT, total_physical_reads BIGINT"
    ),
    "requests": (
        "session_id BIGINT, database_id BIGINT, status STRING, command STRING, cpu_time BIGINT, reads BIGINT, "
        "writes BIGINT, start_time TIMESTAMP_NTZ, blocking_session_id BIGINT, wait_type STRING, wait_time BIGINT, "
        "last_wait_type STRING, statement_start_offset INT, statement_end_offset INT, sql_handle STRING, "
        "plan_handle STRING"
    ),
    "sessions": "session_id BIGINT, host_name STRING, program_name STRING",
    "processes": (
        "spid BIGINT, status STRING, loginame STRING, hostname STRING, blocked BIGINT, open_tran INT, dbid BIGINT, "
        "cmd STRING, waittype STRING, waittime BIGINT, last_batch TIMESTAMP_NTZ"
    ),
    # logs
    "error_log": "log_generation INT, log_date TIMESTAMP_NTZ, process_info STRING, log_text STRING",
    "log_segments": (
        "database_name STRING, recovery_unit_id INT, file_id BIGINT, file_size BIGINT, start_offset BIGINT, "
        "fseq_no BIGINT, status BIGINT, parity BIGINT, create_lsn DECIMAL(38,0)"
    ),
    # files and volumes
    "file_io": (
        "database_id BIGINT, file_id BIGINT, num_of_reads BIGINT, num_of_writes BIGINT, num_of_bytes_read BIGINT, "
        "num_of_bytes_written BIGINT, io_stall_read_ms BIGINT, io_stall_write_ms BIGINT, io_stall BIGINT, "
        "size_on_disk_bytes BIGINT"
    ),
    "files": "database_id BIGINT, file_id BIGINT, physical_name STRING, type_desc STRING, size BIGINT",
    "db_files": "database_id BIGINT, file_id BIGINT, name STRING, type_desc STRING, physical_name STRING",
    "volumes": (
        "database_id BIGINT, file_id BIGINT, volume_mount_point STRING, file_system_type STRING, "
        "logical_volume_name STRING, total_bytes BIGINT, available_bytes BIGINT"
    ),
    # catalog
    "databases": "database_id BIGINT, name STRING, state_desc STRING",
    "objects": "database_id BIGINT, object_id BIGINT, schema_name STRING, name STRING",
    "indexes": (
        "database_id BIGINT, object_id BIGINT, index_id BIGINT, name STRING, type INT, type_desc STRING, "
        "is_unique BOOLEAN, allow_row_locks BOOLEAN, allow_page_locks BOOLEAN, fill_factor INT, is_padded BOOLEAN"
    ),
    "index_usage": (
        "database_id BIGINT, object_id BIGINT, index_id BIGINT, user_seeks BIGINT, user_scans BIGINT, "
        "user_lookups BIGINT, user_updates BIGINT, last_user_seek TIMESTAMP_NTZ, last_user_scan TIMESTAMP_NTZ"
    ),
    "partition_stats": (
        "database_id BIGINT, object_id BIGINT, index_id BIGINT, partition_number INT, used_page_count BIGINT, "
        "in_row_used_page_count BIGINT, in_row_reserved_page_count BIGINT"
    ),
    "index_operational": (
        "database_id BIGINT, object_id BIGINT, index_id BIGINT, partition_number INT, row_lock_count BIGINT, "
        "row_lock_wait_count BIGINT, row_lock_wait_in_ms BIGINT, page_lock_count BIGINT, "
        "page_lock_wait_count BIGINT, page_lock_wait_in_ms BIGINT, page_io_latch_wait_count BIGINT, "
        "page_io_latch_wait_in_ms BIGINT"
    ),
    "index_physical": (
        "database_id BIGINT, object_id BIGINT, index_id BIGINT, partition_number INT, "
        "avg_fragmentation_in_percent DOUBLE, avg_page_space_used_in_percent DOUBLE"
    ),
    "mi_group_stats": (
        "group_handle BIGINT, user_seeks BIGINT, avg_total_user_cost DOUBLE, avg_user_impact DOUBLE, "
        "last_user_seek TIMESTAMP_NTZ"
    ),
    "mi_groups": "index_group_handle BIGINT, index_handle BIGINT",
    "mi_details": (
        "index_handle BIGINT, statement STRING, equality_columns STRING, inequality_columns STRING, "
        "included_columns STRING"
    ),
}

TABLES = tuple(_COLUMNS)

# Columns that hold names or fixed words, which servers compare by collation.
NAME_COLUMNS = {
    "wait_stats": ("wait_type",),
    "latch_stats": ("latch_class",),
    "activity": ("program_name", "host_name", "database_name", "login_name"),
    "jobs": ("name",),
    "schedulers": ("status",),
    "ring_buffer": ("ring_buffer_type",),
    "plan_attributes": ("attribute",),
    "procedures": ("name",),
    "sessions": ("host_name", "program_name"),
    "processes": ("loginame", "hostname"),
    "volumes": ("volume_mount_point", "file_system_type", "logical_volume_name"),
    "log_segments": ("database_name",),
    "databases": ("name", "state_desc"),
    "objects": ("schema_name", "name"),
    "indexes": ("name",),
}


def partition_time(table: str) -> str:
    """Column whose date the table is partitioned by."""
    return "collection_time" if table == "activity" else "collected_at"


def ddl(table: str) -> str:
    """Column list of a table as DDL text."""
    return f"{_FLEET}, {_COLUMNS[table]}"


def schema(table: str) -> StructType:
    """Declared schema of a table."""
    return StructType.fromDDL(ddl(table))
