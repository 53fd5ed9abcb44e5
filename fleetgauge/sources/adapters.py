"""Telemetry tables derived from the test star schema.

There is no captured telemetry to test on, so every telemetry table is bound
to a deterministic projection of the test tables.  The SQL below is plain
enough for both Spark and the checking database; ``{name}`` stands for a test
table.  Keys, hot values and NULLs follow the data, so the work grows with it.

Servers are the five regions, databases the 25 nations; nation n lives on
server n % 5.  Parts, customers and suppliers are dealt out to the nations by
key.  Money and quantities become integer counters.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.sources.snapshots import conform

COLLECTED_AT = "CAST('2024-02-01 00:00:00' AS TIMESTAMP)"


def _server(number: str) -> str:
    return f"'srv' || CAST({number} AS STRING) AS server_name, {COLLECTED_AT} AS collected_at"


def _cents(column: str) -> str:
    return f"CAST(FLOOR({column} * 100 + 0.5) AS BIGINT)"


def _sum(expression: str) -> str:
    return f"CAST(SUM({expression}) AS BIGINT)"


# The integer k of an event's props, '{"k": 69}'.
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_EVENTS = f"(SELECT *, {_K} AS k, {_cents('value')} AS cents FROM {{events}}) AS e"
_LINES = f"""(
            SELECT *, CAST(l_quantity AS BIGINT) AS quantity, {_cents('l_extendedprice')} AS price,
                   {_cents('l_tax')} AS tax, {_cents('l_discount')} AS discount FROM {{lineitem}}) AS l"""
_SUPPLIER_FILE = "s_suppkey % 25 AS database_id, s_suppkey AS file_id"
_FILE_TYPE = "CASE WHEN s_suppkey % 4 = 0 THEN 'LOG' ELSE 'ROWS' END AS type_desc"
_FILE_NAME = "chr(CAST(97 + s_suppkey % 3 AS INT)) || ':/data/f' || CAST(s_suppkey AS STRING) || '.dat' AS physical_name"
_INDEX = "p_partkey % 25 AS database_id, p_partkey AS object_id, p_partkey % 4 AS index_id"
_LINE_INDEX = "l_partkey % 25 AS database_id, l_partkey AS object_id, l_partkey % 4 AS index_id"

# The same text under its statement handle (S) and its plan handle (P).
_TEXTS = f"""
        SELECT {_server('p_partkey % 5')}, 'KIND' || CAST(p_partkey AS STRING) AS handle,
               CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE p_partkey % 25 END AS dbid,
               p_partkey AS objectid,
               'select ' || p_name || ' from ' || p_brand || CASE WHEN p_size % 4 = 0 THEN '   ' ELSE '' END AS text
        FROM {{part}}"""

SQL = {
    "wait_stats": f"""
        SELECT {_server('user_id % 5')},
               CASE user_id % 10 WHEN 0 THEN 'LAZYWRITER_SLEEP' WHEN 3 THEN 'XE_TIMER_EVENT' WHEN 7 THEN 'WAITFOR'
                    ELSE 'W' || CAST(user_id AS STRING) END AS wait_type,
               COUNT(*) AS waiting_tasks_count,
               {_sum('cents')} AS wait_time_ms,
               {_sum("CASE WHEN event_type = 'error' THEN cents ELSE 0 END")} AS signal_wait_time_ms
        FROM {_EVENTS}
        GROUP BY user_id % 5,
                 CASE user_id % 10 WHEN 0 THEN 'LAZYWRITER_SLEEP' WHEN 3 THEN 'XE_TIMER_EVENT' WHEN 7 THEN 'WAITFOR'
                      ELSE 'W' || CAST(user_id AS STRING) END""",
    "latch_stats": f"""
        SELECT {_server('l_suppkey % 5')},
               CASE WHEN l_suppkey % 20 = 0 THEN 'BUFFER' ELSE 'L' || CAST(l_suppkey AS STRING) END AS latch_class,
               COUNT(*) AS waiting_requests_count,
               {_sum('quantity')} AS wait_time_ms
        FROM {_LINES}
        GROUP BY l_suppkey % 5,
                 CASE WHEN l_suppkey % 20 = 0 THEN 'BUFFER' ELSE 'L' || CAST(l_suppkey AS STRING) END""",
    "activity": f"""
        SELECT {_server('user_id % 5')},
               date_trunc('hour', ts) AS collection_time,
               ts - k * INTERVAL '1' SECOND AS start_time,
               '00 00:01:' || lpad(CAST(k % 60 AS STRING), 2, '0') || '.000' AS duration,
               event_id AS session_id,
               CASE WHEN event_type = 'error' THEN user_id END AS blocking_session_id,
               CASE WHEN event_type = 'purchase' THEN k ELSE 0 END AS blocking_session_count,
               cents AS cpu, k * 8 AS used_memory, cents + k AS reads, cents AS writes, k AS physical_reads,
               'L' || CAST(user_id AS STRING) AS login_name,
               'NATION_' || CAST(user_id % 25 AS STRING) AS database_name,
               CASE WHEN k % 3 = 0
                    THEN 'SQLAgent - TSQL JobStep (Job 0x' || lpad(CAST(user_id % 5 + 5 * (k % 7) AS STRING), 2, '0')
                         || '000000221144335566778899AABBCC : Step ' || CAST(k AS STRING) || ')'
                    ELSE 'app' || CAST(user_id % 7 AS STRING) END AS program_name,
               'H' || CAST(user_id % 5 AS STRING) AS host_name,
               event_type AS wait_info, props AS sql_text, event_type || ' ' || props AS sql_command
        FROM {_EVENTS}""",
    "jobs": f"""
        SELECT {_server('n_regionkey')},
               '000000' || lpad(CAST(n_nationkey AS STRING), 2, '0') || '-1122-3344-5566-778899AABBCC' AS job_id,
               CASE WHEN n_nationkey % 6 = 4 THEN NULL ELSE n_name END AS name
        FROM {{nation}}""",
    "schedulers": f"""
        SELECT {_server('o_custkey % 5')},
               o_custkey % 8 AS parent_node_id,
               CASE o_orderstatus WHEN 'F' THEN 'VISIBLE ONLINE' WHEN 'O' THEN 'VISIBLE OFFLINE'
                    ELSE 'HIDDEN ONLINE' END AS status,
               o_orderkey % 17 AS current_tasks_count, o_orderkey % 5 AS runnable_tasks_count,
               o_orderkey % 23 AS active_workers_count, o_orderkey % 11 AS load_factor
        FROM {{orders}}""",
    "sys_info": f"""
        SELECT {_server('user_id % 5')},
               (MAX(event_id) + 10) * 1000 * 2400 + 777 AS cpu_ticks, (MAX(event_id) + 10) * 1000 AS ms_ticks
        FROM {_EVENTS} GROUP BY user_id % 5""",
    "ring_buffer": f"""
        SELECT {_server('user_id % 5')},
               CASE WHEN event_type = 'signup' THEN 'RING_BUFFER_RESOURCE_MONITOR'
                    ELSE 'RING_BUFFER_SCHEDULER_MONITOR' END AS ring_buffer_type,
               event_id * 1000 + k AS timestamp,
               '<Record id="' || CAST(event_id AS STRING) || '" type="MONITOR"><SchedulerMonitorEvent>' ||
               CASE WHEN event_type = 'click' THEN ''
                    ELSE '<SystemHealth><ProcessUtilization>' || CAST(k % 40 AS STRING) || '</ProcessUtilization>' ||
                         CASE WHEN event_type = 'view' AND k % 10 = 0 THEN ''
                              ELSE '<SystemIdle>' || CAST(user_id % 60 AS STRING) || '</SystemIdle>' END
                         || '</SystemHealth>' END
               || '</SchedulerMonitorEvent></Record>' AS record
        FROM {_EVENTS}""",
    "query_stats": f"""
        SELECT {_server('l_partkey % 5')},
               'S' || CAST(l_partkey AS STRING) AS sql_handle, 'P' || CAST(l_partkey AS STRING) AS plan_handle,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 4 ELSE 8 END AS statement_start_offset,
               CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 18 ELSE 4000 END AS statement_end_offset,
               COUNT(*) AS execution_count,
               {_sum('price')} AS total_worker_time,
               MIN(price) AS min_worker_time,
               MAX(price) AS max_worker_time,
               {_sum('tax * 1000 + quantity')} AS total_elapsed_time,
               MIN(tax * 1000 + quantity) AS min_elapsed_time,
               MAX(tax * 1000 + quantity) AS max_elapsed_time,
               {_sum('quantity')} AS total_logical_reads,
               MIN(quantity) AS min_logical_reads, MAX(quantity) AS max_logical_reads,
               {_sum('discount')} AS total_logical_writes,
               MAX(discount) AS max_logical_writes,
               {_sum('l_linenumber')} AS total_physical_reads,
               MIN(l_shipdate) AS creation_time, MAX(l_shipdate) AS last_execution_time
        FROM {_LINES} GROUP BY l_partkey, l_returnflag""",
    "plan_attributes": f"""
        SELECT {_server('p_partkey % 5')}, 'P' || CAST(p_partkey AS STRING) AS plan_handle, 'dbid' AS attribute,
               CASE WHEN p_partkey % 100 = 7 THEN '32767' ELSE CAST(p_partkey % 25 AS STRING) END AS value
        FROM {{part}}
        UNION ALL
        SELECT {_server('p_partkey % 5')}, 'P' || CAST(p_partkey AS STRING) AS plan_handle, 'set_options' AS attribute,
               'SET ' || p_type AS value
        FROM {{part}}""",
    "sql_text": f"{_TEXTS.replace('KIND', 'S')} UNION ALL {_TEXTS.replace('KIND', 'P')}",
    "query_plan": f"""
        SELECT {_server('p_partkey % 5')}, 'P' || CAST(p_partkey AS STRING) AS plan_handle,
               '<ShowPlan name="' || p_type || '"/>' AS query_plan
        FROM {{part}}""",
    "procedures": f"""
        SELECT {_server('c_custkey % 5')}, c_custkey % 25 AS database_id, c_custkey AS object_id, c_name AS name
        FROM {{customer}}""",
    "proc_stats": f"""
        SELECT {_server('o_custkey % 5')}, o_custkey % 25 AS database_id, o_custkey AS object_id,
               MAX(o_orderdate) AS cached_time, COUNT(*) * 1000000 AS execution_count,
               {_sum(_cents('o_totalprice'))} AS total_worker_time,
               {_sum('o_orderkey % 1000')} AS total_elapsed_time,
               {_sum('o_orderkey % 97 + 1')} AS total_logical_reads,
               {_sum("CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 13 ELSE 0 END")} AS total_logical_writes,
               {_sum("CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 7 ELSE 0 END")} AS total_physical_reads
        FROM {{orders}} GROUP BY o_custkey""",
    "requests": f"""
        SELECT {_server('event_id % 5')}, event_id AS session_id, event_id % 5 + 5 * (k % 6) AS database_id,
               CASE WHEN event_type = 'error' THEN 'suspended' ELSE 'running' END AS status, event_type AS command,
               cents AS cpu_time, k AS reads, k % 7 AS writes, ts AS start_time,
               CASE WHEN event_type = 'error' THEN event_id - 5 ELSE 0 END AS blocking_session_id,
               CASE WHEN event_type = 'error' THEN 'LCK_M_X' END AS wait_type, k * 10 AS wait_time,
               'W' || CAST(k % 9 AS STRING) AS last_wait_type,
               (k % 6) * 2 AS statement_start_offset,
               CASE WHEN k % 4 = 0 THEN -1 ELSE (k % 6) * 2 + k END AS statement_end_offset,
               'S' || CAST(event_id % 5 + 5 * (k % 40) AS STRING) AS sql_handle,
               CASE WHEN k % 2 = 0 THEN 'P' || CAST(event_id % 5 + 5 * (k % 40) AS STRING) END AS plan_handle
        FROM {_EVENTS}""",
    "sessions": f"""
        SELECT {_server('event_id % 5')}, event_id AS session_id, 'H' || CAST(user_id % 11 AS STRING) AS host_name,
               'app' || CAST(user_id % 7 AS STRING) AS program_name
        FROM {{events}}""",
    "processes": f"""
        SELECT {_server('event_id % 5')}, event_id AS spid, event_type AS status,
               'login-name-' || CAST(user_id AS STRING) AS loginame, 'workstation-' || CAST(user_id AS STRING) AS hostname,
               CASE WHEN event_type = 'error' AND event_id >= 5 THEN event_id - 5 ELSE 0 END AS blocked,
               k % 3 AS open_tran, event_id % 5 + 5 * (k % 6) AS dbid, event_type AS cmd,
               CASE WHEN event_type = 'error' THEN 'LCK_M_X' END AS waittype, k * 10 AS waittime, ts AS last_batch
        FROM {_EVENTS}""",
    "log_segments": f"""
        SELECT {_server('l_suppkey % 5')},
               'NATION_' || CAST(CASE WHEN l_suppkey % 25 = 3 THEN 8 ELSE l_suppkey % 25 END AS STRING) AS database_name,
               0 AS recovery_unit_id, l_linenumber AS file_id, price AS file_size,
               l_orderkey AS start_offset, l_orderkey AS fseq_no, 2 AS status, 64 AS parity, l_partkey AS create_lsn
        FROM {_LINES}""",
    "file_io": f"""
        SELECT {_server('l_suppkey % 5')}, l_suppkey % 25 AS database_id, l_suppkey AS file_id,
               {_sum("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")} AS num_of_reads,
               {_sum("CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END")} AS num_of_writes,
               {_sum("CASE WHEN l_returnflag = 'R' THEN price ELSE 0 END")} AS num_of_bytes_read,
               {_sum("CASE WHEN l_returnflag = 'N' THEN price ELSE 0 END")} AS num_of_bytes_written,
               {_sum("CASE WHEN l_returnflag = 'R' THEN quantity ELSE 0 END")} AS io_stall_read_ms,
               {_sum("CASE WHEN l_returnflag = 'N' THEN quantity ELSE 0 END")} AS io_stall_write_ms,
               {_sum('quantity')} AS io_stall,
               {_sum('price')} AS size_on_disk_bytes
        FROM {_LINES} GROUP BY l_suppkey""",
    "files": f"""
        SELECT {_server('s_suppkey % 5')}, {_SUPPLIER_FILE}, {_FILE_NAME}, {_FILE_TYPE},
               {_cents('s_acctbal + 3000')} AS size
        FROM {{supplier}}""",
    "db_files": f"""
        SELECT {_server('s_suppkey % 5')}, {_SUPPLIER_FILE}, s_name AS name, {_FILE_TYPE}, {_FILE_NAME}
        FROM {{supplier}}""",
    "volumes": f"""
        SELECT {_server('s_suppkey % 5')}, {_SUPPLIER_FILE},
               'M' || CAST(s_suppkey % 7 AS STRING) || ':/' AS volume_mount_point,
               CASE WHEN s_nationkey % 2 = 0 THEN 'NTFS' ELSE 'ReFS' END AS file_system_type,
               'vol' || CAST(s_nationkey AS STRING) AS logical_volume_name,
               (s_suppkey % 3 + 3) * 123456789012 AS total_bytes, (s_suppkey % 3 + 1) * 98765432109 AS available_bytes
        FROM {{supplier}}""",
    "databases": f"""
        SELECT {_server('n_regionkey')}, n_nationkey AS database_id, n_name AS name,
               CASE WHEN n_nationkey % 7 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc
        FROM {{nation}}""",
    "objects": f"""
        SELECT {_server('p_partkey % 5')}, p_partkey % 25 AS database_id, p_partkey AS object_id,
               CASE WHEN p_size > 40 THEN 'app' ELSE 'dbo' END AS schema_name,
               p_name || ' ' || CAST(p_size AS STRING) AS name
        FROM {{part}}""",
    "indexes": f"""
        SELECT {_server('p_partkey % 5')}, {_INDEX},
               CASE p_size % 4 WHEN 0 THEN 'PK_' || p_name WHEN 1 THEN NULL ELSE 'IX_' || p_brand END AS name,
               CASE WHEN p_size % 9 = 0 THEN 1 ELSE 2 END AS type,
               CASE WHEN p_size % 9 = 0 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END AS type_desc,
               p_size % 8 = 3 AS is_unique, p_size % 2 = 0 AS allow_row_locks, p_size % 3 = 0 AS allow_page_locks,
               p_size AS fill_factor, p_size > 25 AS is_padded
        FROM {{part}}""",
    # Some indexes have no usage row: theirs carry the id of an index that is not there.
    "index_usage": f"""
        SELECT {_server('l_partkey % 5')}, l_partkey % 25 AS database_id, l_partkey AS object_id,
               l_partkey % 4 + CASE WHEN l_partkey % 11 = 3 THEN 100 ELSE 0 END AS index_id,
               {_sum("CASE WHEN l_returnflag = 'R' AND l_quantity = 50 THEN 1 ELSE 0 END")} AS user_seeks,
               {_sum("CASE WHEN l_returnflag = 'R' AND l_quantity = 49 THEN 1 ELSE 0 END")} AS user_scans,
               {_sum("CASE WHEN l_returnflag = 'R' AND l_quantity = 48 THEN 1 ELSE 0 END")} AS user_lookups,
               COUNT(*) AS user_updates,
               MAX(CASE WHEN l_returnflag = 'R' AND l_quantity = 50 THEN l_shipdate END) AS last_user_seek,
               MAX(CASE WHEN l_returnflag = 'R' AND l_quantity = 49 THEN l_shipdate END) AS last_user_scan
        FROM {_LINES} GROUP BY l_partkey""",
    "partition_stats": " UNION ALL ".join(
        f"""
        SELECT {_server('p_partkey % 5')}, {_INDEX}, {n} AS partition_number, p_size * {400 * n} AS used_page_count,
               p_size * {30 * n} + 1 AS in_row_used_page_count, p_size * {40 * n} + 1 AS in_row_reserved_page_count
        FROM {{part}}"""
        for n in (1, 2)
    ),
    "index_operational": f"""
        SELECT {_server('l_partkey % 5')}, {_LINE_INDEX}, l_linenumber % 2 + 1 AS partition_number,
               COUNT(*) AS row_lock_count, {_sum('l_linenumber')} AS row_lock_wait_count,
               {_sum('quantity')} AS row_lock_wait_in_ms, MIN(quantity) AS page_lock_count,
               MAX(quantity) AS page_lock_wait_count, {_sum('quantity * 2')} AS page_lock_wait_in_ms,
               {_sum('discount')} AS page_io_latch_wait_count,
               {_sum('tax')} AS page_io_latch_wait_in_ms
        FROM {_LINES} GROUP BY l_partkey, l_linenumber % 2""",
    "index_physical": " UNION ALL ".join(
        f"""
        SELECT {_server('p_partkey % 5')}, {_INDEX}, {n} AS partition_number,
               CAST(p_size AS DOUBLE) * {n} / 2 AS avg_fragmentation_in_percent,
               CAST(p_size AS DOUBLE) * {n} / 4 AS avg_page_space_used_in_percent
        FROM {{part}}"""
        for n in (1, 2)
    ),
    "mi_group_stats": f"""
        SELECT {_server('p_partkey % 5')}, p_partkey AS group_handle, p_size * 3 AS user_seeks,
               FLOOR(p_retailprice) * 1.0 AS avg_total_user_cost,
               CAST(p_partkey % 100 AS DOUBLE) AS avg_user_impact,
               {COLLECTED_AT} - p_size * INTERVAL '1' HOUR AS last_user_seek
        FROM {{part}}""",
    "mi_groups": f"""
        SELECT {_server('p_partkey % 5')}, p_partkey AS index_group_handle, p_partkey * 2 + 1 AS index_handle
        FROM {{part}}""",
    "mi_details": f"""
        SELECT {_server('p_partkey % 5')}, p_partkey * 2 + 1 AS index_handle,
               '[NATION_' || CAST(p_partkey % 25 AS STRING) || '].[dbo].[' || p_name || ']' AS statement,
               CASE WHEN p_size % 2 = 0 THEN '[' || p_brand || ']' END AS equality_columns,
               CASE WHEN p_size % 3 = 0 THEN '[' || p_type || ']' END AS inequality_columns,
               CASE WHEN p_size % 5 < 2 THEN '[p_name], [p_size]' END AS included_columns
        FROM {{part}}""",
}

# One log line per line of text; the engines differ in how they split.
_LOG_COLUMNS = """
               CAST(doc_id % 7 AS INT) AS log_generation,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' MINUTE AS log_date,
               source AS process_info"""
ERROR_LOG_SPARK = f"""
        SELECT {_server('doc_id % 5')}, {_LOG_COLUMNS}, log_text
        FROM {{documents}} LATERAL VIEW explode(split(text, chr(10))) AS log_text"""
ERROR_LOG_CHECK = f"""
        SELECT {_server('doc_id % 5')}, {_LOG_COLUMNS}, unnest(string_split(text, chr(10))) AS log_text
        FROM {{documents}}"""


# Columns of the test tables that are read, so that no job has to look them up.
_TEST_TABLES = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, source STRING",
}


def telemetry(spark: SparkSession, sf_dir: str, tables: Iterable[str]) -> dict[str, DataFrame]:
    """Telemetry tables over the test tables in ``sf_dir``, in declared types."""
    sources = {}
    for name, columns in _TEST_TABLES.items():
        if any(f"{{{name}}}" in _spark_sql(table) for table in tables):
            sources[name] = spark.read.schema(columns).parquet(os.path.join(sf_dir, f"{name}.parquet"))
    out = {}
    for table in tables:
        sql = _spark_sql(table)
        df = spark.sql(sql, **{name: df for name, df in sources.items() if f"{{{name}}}" in sql})
        if table == "activity":
            df = df.withColumnRenamed("duration", "dd hh:mm:ss.mss")
        out[table] = conform(df, table)
    return out


def _spark_sql(table: str) -> str:
    return ERROR_LOG_SPARK if table == "error_log" else SQL[table]


def check_sql(table: str) -> str:
    """The same table as SQL text for the checking database."""
    sql = ERROR_LOG_CHECK if table == "error_log" else SQL[table]
    return re.sub(r"\{(\w+)\}", r"\1", sql)
