"""The reports written a second time, as SQL for the checking database.

Formulations differ from the Spark ones on purpose: running totals by
self-join, boundary counts by ``date_diff``, unranked totals by subquery,
fractions by integer arithmetic.
"""

from __future__ import annotations

from checks.queries import (
    ALLOWED, APPENDED, CUT, LISTED, LOG_TERMS, ONE_DATABASE, ONE_TABLE, OWN_SESSIONS, RANGE, ROLLED_UP, STORED, WARNING_TERM,
)
from fleetgauge.plans.waits import HELP_URL, benign_waits
from fleetgauge.sources.adapters import check_sql

_K = "server_name, collected_at"


def _with(tables: str, body: str) -> str:
    """``body`` after the named telemetry tables; it may go on with more CTEs."""
    ctes = ", ".join(f"{t} AS ({check_sql(t)})" for t in tables.split())
    return f"WITH {ctes} {body}"


def _ratio(num: str, den: str, scale: int) -> str:
    """num / den rounded half up to ``scale`` digits, NULL for a zero denominator."""
    n, d = f"abs(CAST({num} AS HUGEINT))", f"abs(CAST({den} AS HUGEINT))"
    steps = f"(2 * {n} * {10**scale} + {d}) // (2 * NULLIF({d}, 0))"
    return f"CAST(sign({num}) * ({steps}) AS DOUBLE) / {10**scale}"


def _pct(part: str, whole: str, scale: int) -> str:
    return _ratio(f"(100 * CAST({part} AS HUGEINT))", f"({whole})", scale)


def _div(num: str, den: str) -> str:
    return f"CAST(({num}) // NULLIF({den}, 0) AS BIGINT)"


def _on(a: str, b: str, *columns: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("server_name", "collected_at", *columns))


def _pareto(table: str, where: str, entity: str) -> str:
    """CTEs ending in ``kept``: the 95 percent prefix by a self-join running total."""
    return f"""
    , ranked AS (
        SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY wait_time_ms DESC, {entity}) AS row_rank
        FROM {table} WHERE {where})
    , totals AS (SELECT {_K}, sum(wait_time_ms) AS total FROM ranked GROUP BY {_K})
    , priors AS (
        SELECT a.server_name, a.collected_at, a.row_rank, coalesce(sum(b.wait_time_ms), 0) AS prior
        FROM ranked a LEFT JOIN ranked b ON {_on('a', 'b')} AND b.row_rank < a.row_rank
        GROUP BY a.server_name, a.collected_at, a.row_rank)
    , kept AS (
        SELECT a.*, t.total FROM ranked a
        JOIN priors p ON {_on('a', 'p', 'row_rank')} JOIN totals t ON {_on('a', 't')}
        WHERE p.prior * 100 < 95 * t.total)"""


def _wait_pareto() -> str:
    ignored = ", ".join(f"'{w}'" for w in benign_waits())
    resource = "(wait_time_ms - signal_wait_time_ms)"
    per_task = "(1000 * waiting_tasks_count)"
    return _with(
        "wait_stats",
        _pareto("wait_stats", f"wait_type NOT IN ({ignored}) AND waiting_tasks_count > 0", "wait_type")
        + f"""
    SELECT {_K}, row_rank, wait_type, {_ratio('wait_time_ms', '1000', 2)} AS wait_s,
           {_ratio(resource, '1000', 2)} AS resource_s, {_ratio('signal_wait_time_ms', '1000', 2)} AS signal_s,
           waiting_tasks_count AS wait_count, {_pct('wait_time_ms', 'total', 2)} AS percentage,
           {_ratio('wait_time_ms', per_task, 4)} AS avg_wait_s, {_ratio(resource, per_task, 4)} AS avg_resource_s,
           {_ratio('signal_wait_time_ms', per_task, 4)} AS avg_signal_s, '{HELP_URL}' || wait_type AS help_url
    FROM kept""",
    )


def _latch_pareto() -> str:
    return _with(
        "latch_stats",
        _pareto("latch_stats", "latch_class <> 'BUFFER' AND wait_time_ms > 0", "latch_class")
        + f"""
    SELECT {_K}, row_rank, latch_class, {_ratio('wait_time_ms', '1000', 2)} AS wait_s,
           waiting_requests_count AS wait_count, {_pct('wait_time_ms', 'total', 2)} AS percentage,
           {_ratio('wait_time_ms', '(1000 * waiting_requests_count)', 4)} AS avg_wait_s
    FROM kept""",
    )


def _log(where: str) -> str:
    return _with("error_log", f"SELECT {_K}, log_date, process_info, log_text FROM error_log WHERE {where}")


def _log_search() -> str:
    return _log("log_generation = 0 AND " + " AND ".join(f"log_text ILIKE '%{t}%'" for t in LOG_TERMS))


_SCHEDULER_COUNT = _with(
    "schedulers",
    f"""SELECT {_K}, CAST(parent_node_id AS INTEGER) AS parent_node_id, count(*) AS scheduler_count
    FROM schedulers WHERE status = 'VISIBLE ONLINE' GROUP BY {_K}, parent_node_id""",
)

_SCHEDULER_LOAD = _with(
    "schedulers",
    f"""SELECT {_K}, status, count(*) AS scheduler_count,
        CAST(sum(current_tasks_count) AS BIGINT) AS current_tasks_count,
        CAST(sum(runnable_tasks_count) AS BIGINT) AS runnable_tasks_count,
        CAST(sum(active_workers_count) AS BIGINT) AS active_workers_count,
        CAST(trunc(avg(load_factor)) AS BIGINT) AS load_factor
    FROM schedulers GROUP BY {_K}, status""",
)

# Straight from the events, without the XML in between.
_CPU_HISTORY = """
    WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events),
    clock AS (SELECT user_id % 5 AS server, (max(event_id) + 10) * 1000 AS now_ms FROM e GROUP BY 1),
    samples AS (
        SELECT e.*, now_ms, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id DESC) AS n,
               CASE WHEN event_type = 'view' AND k % 10 = 0 THEN NULL ELSE user_id % 60 END AS idle
        FROM e JOIN clock ON server = user_id % 5 WHERE event_type NOT IN ('signup', 'click'))
    SELECT 'srv' || (user_id % 5) AS server_name, TIMESTAMP '2024-02-01 00:00:00' AS collected_at,
           CAST(k % 40 AS INTEGER) AS process_cpu, CAST(idle AS INTEGER) AS system_idle,
           CAST(100 - idle - k % 40 AS INTEGER) AS other_cpu,
           TIMESTAMP '2024-02-01 00:00:00' - (now_ms - event_id * 1000 - k) * INTERVAL '1' MILLISECOND AS event_time
    FROM samples WHERE n <= 256"""

_CPU_BY_DATABASE = _with(
    "query_stats plan_attributes databases",
    f""", per AS (
        SELECT q.server_name, q.collected_at, TRY_CAST(a.value AS BIGINT) AS database_id,
               sum(q.total_worker_time // 1000) AS cpu_time_ms
        FROM query_stats q JOIN plan_attributes a ON {_on('q', 'a', 'plan_handle')}
        WHERE a.attribute = 'dbid' GROUP BY ALL)
    , kept AS (SELECT * FROM per WHERE database_id IS DISTINCT FROM 32767)
    SELECT k.server_name, k.collected_at,
           (SELECT count(*) FROM kept o WHERE {_on('o', 'k')} AND (o.cpu_time_ms > k.cpu_time_ms
                OR o.cpu_time_ms = k.cpu_time_ms
                AND coalesce(o.database_id, -1) <= coalesce(k.database_id, -1))) AS cpu_rank,
           d.name AS database_name, CAST(k.cpu_time_ms AS BIGINT) AS cpu_time_ms,
           {_pct('k.cpu_time_ms', f"(SELECT sum(o.cpu_time_ms) FROM kept o WHERE {_on('o', 'k')})", 2)} AS cpu_percent
    FROM kept k LEFT JOIN databases d ON {_on('k', 'd', 'database_id')}""",
)

_IO_BY_DATABASE = _with(
    "file_io databases",
    f""", kept AS (
        SELECT {_K}, database_id, sum(num_of_bytes_read + num_of_bytes_written) // 1048576 AS io_mb
        FROM file_io GROUP BY ALL)
    SELECT k.server_name, k.collected_at,
           (SELECT count(*) FROM kept o WHERE {_on('o', 'k')} AND (o.io_mb > k.io_mb
                OR o.io_mb = k.io_mb AND o.database_id <= k.database_id)) AS io_rank,
           d.name AS database_name, CAST(k.io_mb AS DOUBLE) AS total_io_mb,
           {_pct('k.io_mb', f"(SELECT sum(o.io_mb) FROM kept o WHERE {_on('o', 'k')})", 2)} AS io_percent
    FROM kept k LEFT JOIN databases d ON {_on('k', 'd', 'database_id')}""",
)

_STATEMENT = "plan_handle, sql_handle, statement_start_offset, statement_end_offset"

_TOP_WORKER = _with(
    "query_stats sql_text databases",
    f"""SELECT q.server_name, q.collected_at, d.name AS database_name, t.text AS query_text,
           total_worker_time, min_worker_time, {_div('total_worker_time', 'execution_count')} AS avg_worker_time,
           max_worker_time, min_elapsed_time, {_div('total_elapsed_time', 'execution_count')} AS avg_elapsed_time,
           max_elapsed_time, min_logical_reads, {_div('total_logical_reads', 'execution_count')} AS avg_logical_reads,
           max_logical_reads, execution_count, creation_time
    FROM query_stats q JOIN sql_text t ON {_on('q', 't')} AND t.handle = q.plan_handle
    LEFT JOIN databases d ON {_on('q', 'd')} AND d.database_id = t.dbid
    QUALIFY row_number() OVER (PARTITION BY q.server_name, q.collected_at
        ORDER BY total_worker_time DESC NULLS LAST, {_STATEMENT}) <= 50""",
)


def _top_cpu(order: str) -> str:
    average = _div("total_worker_time", "execution_count")
    return _with(
        "query_stats sql_text databases objects",
        f"""SELECT q.server_name, q.collected_at, o.schema_name || '.' || o.name AS object_name, t.text AS text_data,
           total_physical_reads AS disk_reads, total_logical_reads AS memory_reads, execution_count AS executions,
           total_worker_time AS total_cpu_time, {average} AS average_cpu_time,
           total_elapsed_time AS disk_wait_and_cpu_time, max_logical_writes AS memory_writes,
           creation_time AS date_cached, d.name AS database_name, last_execution_time
    FROM query_stats q JOIN sql_text t ON {_on('q', 't')} AND t.handle = q.sql_handle
    LEFT JOIN databases d ON {_on('q', 'd')} AND d.database_id = t.dbid
    LEFT JOIN objects o ON {_on('q', 'o')} AND o.database_id = t.dbid AND o.object_id = t.objectid
    QUALIFY row_number() OVER (PARTITION BY q.server_name, q.collected_at
        ORDER BY {order} DESC NULLS LAST, {_STATEMENT}) <= 50""",
    )


def _slice(start: str, end: str, legacy: bool) -> str:
    if legacy:
        whole, extra = "2 * length(rtrim(t.text, ' '))", 0
    else:
        whole, extra = "2 * length(t.text)", 1
    size = f"(CASE WHEN {end} = -1 THEN {whole} ELSE {end} END - {start}) // 2 + {extra}"
    return f"substring(t.text, {start} // 2 + {extra}, greatest({size}, 0))"


# UTF-16 units of a text in a list; the second half of a character of two is an empty string.
_UNITS = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [c, ''] ELSE [c] END))"


def _unit_slice(start: str, end: str, legacy: bool) -> str:
    """The same over units, half a character at either end as U+FFFD."""
    measured, extra = ("rtrim(t.text, ' ')", 0) if legacy else ("t.text", 1)
    first = f"({start} // 2 + {extra})"
    size = f"((CASE WHEN {end} = -1 THEN 2 * len({_UNITS.format(measured)}) ELSE {end} END - {start}) // 2 + {extra})"
    units = f"list_slice({_UNITS.format('t.text')}, greatest({first}, 1), greatest({first} + {size} - 1, 0))"
    mended = (
        f"list_transform({units}, lambda u, i: CASE WHEN i = 1 AND u = '' OR unicode(u) > 65535"
        f" AND i = len({units}) THEN chr(65533) ELSE u END)"
    )
    return f"CASE WHEN t.text IS NOT NULL AND {start} IS NOT NULL THEN array_to_string({mended}, '') END"


def _beyond_bmp(sql: str, legacy: bool) -> str:
    """The same over texts with characters of two units, slices counted in units."""
    offsets = ("statement_start_offset", "statement_end_offset", legacy)
    texts = check_sql("sql_text")
    sql = sql.replace(_slice(*offsets), _unit_slice(*offsets))
    edited = "'\U0001f600' || left(text, 5) || '\U0001f600\U0001d11e' || substring(text, 6)"
    return sql.replace(f"sql_text AS ({texts})", f"sql_text AS (SELECT * REPLACE ({edited} AS text) FROM ({texts}))")


_TOP_AVG_IO = _with(
    "query_stats sql_text databases objects",
    f"""SELECT q.server_name, q.collected_at, d.name AS database_name, o.name AS sp_name,
           {_div('total_logical_reads + total_logical_writes', 'execution_count')} AS avg_io, execution_count,
           {_slice('statement_start_offset', 'statement_end_offset', True)} AS query_text
    FROM query_stats q JOIN sql_text t ON {_on('q', 't')} AND t.handle = q.sql_handle
    JOIN databases d ON {_on('q', 'd')} AND d.database_id = t.dbid
    LEFT JOIN objects o ON {_on('q', 'o')} AND o.database_id = t.dbid AND o.object_id = t.objectid
    QUALIFY row_number() OVER (PARTITION BY q.server_name, q.collected_at, t.dbid
        ORDER BY avg_io DESC NULLS LAST, sql_handle, plan_handle, statement_start_offset, statement_end_offset) <= 50""",
)

_MINUTES = "date_diff('minute', s.cached_time, s.collected_at)"
_CALLS = f"coalesce({_div('execution_count', _MINUTES)}, 0)"


def _top_procedures(total: str, extra: str = "", where: str = "TRUE", order: str = "") -> str:
    return _with(
        "proc_stats procedures databases",
        f"""SELECT s.server_name, s.collected_at, d.name AS database_name, p.name AS sp_name, {total},
           {_div(total, 'execution_count')} AS {total.replace('total', 'avg')}, execution_count, {extra}
           total_elapsed_time, {_div('total_elapsed_time', 'execution_count')} AS avg_elapsed_time, cached_time
    FROM proc_stats s JOIN procedures p ON {_on('s', 'p', 'database_id', 'object_id')}
    JOIN databases d ON {_on('s', 'd', 'database_id')}
    WHERE {where}
    QUALIFY row_number() OVER (PARTITION BY s.server_name, s.collected_at, s.database_id
        ORDER BY {total} DESC NULLS LAST, {order} s.object_id) <= 25""",
    )


_ACTIVE = _with(
    "requests sessions sql_text query_plan databases",
    f"""SELECT r.server_name, r.collected_at, r.session_id, t.text AS text_command, d.name AS database_name,
           s.host_name, s.program_name, status, command, cpu_time, reads, writes,
           date_diff('day', start_time, r.collected_at) || 'd '
           || right('00' || date_diff('hour', start_time, r.collected_at) % 24, 2) || ':'
           || right('00' || date_diff('minute', start_time, r.collected_at) % 60, 2) || ':'
           || right('00' || date_diff('second', start_time, r.collected_at) % 60, 2) AS duration,
           start_time, blocking_session_id, wait_type, wait_time, last_wait_type,
           '<?query --' || chr(13) || {_slice('statement_start_offset', 'statement_end_offset', False)}
           || chr(13) || '--?>' AS sql_statement, query_plan
    FROM requests r JOIN sessions s ON {_on('r', 's', 'session_id')}
    JOIN sql_text t ON {_on('r', 't')} AND t.handle = r.sql_handle
    LEFT JOIN query_plan p ON {_on('r', 'p', 'plan_handle')}
    LEFT JOIN databases d ON {_on('r', 'd', 'database_id')}
    WHERE r.session_id NOT IN ({', '.join(map(str, OWN_SESSIONS))})""",
)

_HEADS = _with(
    "processes requests sql_text databases",
    f"""SELECT sp.server_name, sp.collected_at, spid, sp.status, left(loginame, 12) AS loginame,
           left(hostname, 12) AS hostname, rpad(CAST(blocked AS VARCHAR), 3, ' ') AS blk,
           CAST(open_tran AS INTEGER) AS open_tran, left(d.name, 10) AS dbname, cmd, waittype, waittime, last_batch,
           {_slice('statement_start_offset', 'statement_end_offset', True)} AS sql_statement
    FROM processes sp LEFT JOIN databases d ON {_on('sp', 'd')} AND d.database_id = sp.dbid
    LEFT JOIN requests r ON {_on('sp', 'r')} AND r.session_id = sp.spid
    LEFT JOIN sql_text t ON {_on('r', 't')} AND t.handle = r.sql_handle
    WHERE blocked = 0 AND (sp.server_name, sp.collected_at, spid) IN (SELECT {_K}, blocked FROM processes)""",
)

_SEGMENTS = _with(
    "log_segments databases",
    f"""SELECT d.server_name, d.collected_at, d.name AS database_name,
           (SELECT count(*) FROM log_segments s WHERE {_on('s', 'd')} AND s.database_name = d.name) AS segment_count
    FROM databases d""",
)


def _guarded(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0 ELSE CAST(({num}) // ({den}) AS BIGINT) END"


_DRIVES = _with(
    "file_io files volumes",
    f""", sums AS (
        SELECT f.server_name, f.collected_at, upper(left(f.physical_name, 2)) AS drive, volume_mount_point,
               sum(num_of_reads) AS r, sum(num_of_writes) AS w, sum(io_stall_read_ms) AS rs, sum(io_stall_write_ms) AS ws,
               sum(io_stall) AS s, sum(num_of_bytes_read) AS rb, sum(num_of_bytes_written) AS wb
        FROM file_io i JOIN files f ON {_on('i', 'f', 'database_id', 'file_id')}
        JOIN volumes v ON {_on('i', 'v', 'database_id', 'file_id')} GROUP BY ALL)
    SELECT {_K}, drive, volume_mount_point, {_guarded('rs', 'r')} AS read_latency, {_guarded('ws', 'w')} AS write_latency,
           {_guarded('s', 'r + w')} AS overall_latency, {_guarded('rb', 'r')} AS avg_bytes_per_read,
           {_guarded('wb', 'w')} AS avg_bytes_per_write, {_guarded('rb + wb', 'r + w')} AS avg_bytes_per_transfer
    FROM sums""",
)

_STALLS = _with(
    "file_io files databases",
    f"""SELECT i.server_name, i.collected_at, d.name AS database_name,
           {_ratio('io_stall_read_ms', '(num_of_reads + 1)', 1)} AS avg_read_stall_ms,
           {_ratio('io_stall_write_ms', '(num_of_writes + 1)', 1)} AS avg_write_stall_ms,
           {_ratio('(io_stall_read_ms + io_stall_write_ms)', '(num_of_reads + num_of_writes + 1)', 1)} AS avg_io_stall_ms,
           {_ratio('size', '128', 2)} AS file_size_mb, physical_name, type_desc, io_stall_read_ms, num_of_reads,
           io_stall_write_ms, num_of_writes, io_stall_read_ms + io_stall_write_ms AS io_stalls,
           num_of_reads + num_of_writes AS total_io
    FROM file_io i JOIN files f ON {_on('i', 'f', 'database_id', 'file_id')}
    LEFT JOIN databases d ON {_on('i', 'd', 'database_id')}""",
)

_VOLUMES = _with(
    "files volumes",
    f"""SELECT DISTINCT v.server_name, v.collected_at, volume_mount_point, file_system_type, logical_volume_name,
           {_ratio('total_bytes', '1073741824', 2)} AS total_gb,
           {_ratio('available_bytes', '1073741824', 2)} AS available_gb,
           {_pct('available_bytes', 'total_bytes', 2)} AS free_percent
    FROM files f JOIN volumes v ON {_on('f', 'v', 'database_id', 'file_id')}""",
)

_PROFILE = _with(
    "file_io db_files databases",
    f"""SELECT i.server_name, i.collected_at, d.name AS database_name, f.name AS logical_name, i.file_id, type_desc,
           physical_name, {_ratio('size_on_disk_bytes', '1048576', 2)} AS size_on_disk_mb, num_of_reads, num_of_writes,
           io_stall_read_ms, io_stall_write_ms,
           {_pct('io_stall_read_ms', 'io_stall_read_ms + io_stall_write_ms', 1)} AS io_stall_reads_pct,
           {_pct('io_stall_write_ms', 'io_stall_read_ms + io_stall_write_ms', 1)} AS io_stall_writes_pct,
           num_of_reads + num_of_writes AS total_io, {_ratio('num_of_bytes_read', '1048576', 2)} AS mb_read,
           {_ratio('num_of_bytes_written', '1048576', 2)} AS mb_written,
           {_pct('num_of_reads', 'num_of_reads + num_of_writes', 1)} AS reads_pct,
           {_pct('num_of_writes', 'num_of_reads + num_of_writes', 1)} AS writes_pct,
           {_pct('num_of_bytes_read', 'num_of_bytes_read + num_of_bytes_written', 1)} AS read_bytes_pct,
           {_pct('num_of_bytes_written', 'num_of_bytes_read + num_of_bytes_written', 1)} AS written_bytes_pct
    FROM file_io i JOIN db_files f ON {_on('i', 'f', 'database_id', 'file_id')}
    JOIN databases d ON {_on('i', 'd', 'database_id')}""",
)

_MISSING = _with(
    "mi_group_stats mi_groups mi_details",
    f"""SELECT s.server_name, s.collected_at,
           CAST(CAST(user_seeks * avg_total_user_cost * (avg_user_impact * 0.01) AS DECIMAL(18,2)) AS DOUBLE)
               AS index_advantage,
           avg_user_impact AS user_impact, CAST(CAST(avg_total_user_cost AS DECIMAL(18,2)) AS DOUBLE) AS avg_cost,
           CAST(user_seeks AS BIGINT) AS seeks, statement AS table_name,
           coalesce(equality_columns, '') AS equality_columns, coalesce(inequality_columns, '') AS inequality_columns,
           coalesce(included_columns, '') AS included_columns, last_user_seek AS last_seek,
           'CREATE INDEX [missing_index_' || g.index_group_handle || '_' || d.index_handle || '_'
           || left(trim(string_split(statement, '.')[-1], '[]'), 32) || '] ON ' || statement || ' ('
           || concat_ws(',', equality_columns, inequality_columns) || ')'
           || CASE WHEN included_columns IS NULL THEN '' ELSE ' INCLUDE (' || included_columns || ')' END
               AS create_index_statement
    FROM mi_group_stats s JOIN mi_groups g ON {_on('s', 'g')} AND g.index_group_handle = s.group_handle
    JOIN mi_details d ON {_on('s', 'd')} AND d.index_handle = g.index_handle
    QUALIFY row_number() OVER (PARTITION BY s.server_name, s.collected_at
        ORDER BY index_advantage DESC, g.index_group_handle, d.index_handle) <= 50""",
)


def _unused(database_of_usage: str) -> str:
    reads = [f"coalesce(u.{c}, 0) AS {n}" for c, n in (
        ("user_seeks", "seeks"), ("user_scans", "scans"), ("user_lookups", "lookups"), ("user_updates", "updates"))]
    return _with(
        "databases indexes objects index_usage partition_stats",
        f""", lines AS (
        SELECT i.server_name, i.collected_at, d.name AS database_name, o.name AS table_view, i.name AS index_name,
               {', '.join(reads)}, coalesce(sum(p.used_page_count) * 8, 0) AS size_kb
        FROM indexes i JOIN databases d ON {_on('i', 'd', 'database_id')}
        JOIN objects o ON {_on('i', 'o', 'database_id', 'object_id')}
        LEFT JOIN index_usage u ON {_on('i', 'u', 'database_id', 'object_id', 'index_id')}
        LEFT JOIN partition_stats p ON {_on('i', 'p', 'database_id', 'object_id', 'index_id')}
        WHERE d.state_desc = 'ONLINE' AND i.name IS NOT NULL AND i.name NOT LIKE 'PK_%' AND i.type = 2
              AND NOT i.is_unique AND {database_of_usage}
        GROUP BY ALL)
    SELECT {_K}, database_name, table_view, index_name, CAST(seeks AS BIGINT) AS seeks, CAST(scans AS BIGINT) AS scans,
           CAST(lookups AS BIGINT) AS lookups, CAST(updates AS BIGINT) AS updates,
           CAST(size_kb // 1024 AS BIGINT) AS index_size_mb,
           'DROP INDEX [' || index_name || '] ON [' || database_name || '].[dbo].[' || table_view
           || '] WITH ( ONLINE = OFF )' AS drop_index_statement
    FROM lines WHERE seeks = 0 AND scans = 0 AND lookups = 0""",
    )


def _index_profile(pages: str) -> str:
    reads = "u.user_scans + u.user_seeks + u.user_lookups"
    return _with(
        "index_usage databases objects indexes index_operational index_physical partition_stats",
        f"""SELECT u.server_name, u.collected_at, d.name AS database_name, o.name AS table_name, x.name AS index_name,
           x.type_desc, CAST(f.partition_number AS INTEGER) AS partition_number, user_seeks, last_user_seek, user_scans,
           last_user_scan, user_lookups, user_updates AS total_user_writes, {reads} AS total_user_reads,
           user_updates - ({reads}) AS write_read_difference, allow_row_locks, row_lock_count, row_lock_wait_count,
           row_lock_wait_in_ms, allow_page_locks, page_lock_count, page_lock_wait_count, page_lock_wait_in_ms,
           CAST(fill_factor AS INTEGER) AS fill_factor, is_padded, avg_fragmentation_in_percent,
           avg_page_space_used_in_percent, CAST(in_row_used_page_count AS BIGINT) AS used_pages,
           CAST(in_row_reserved_page_count AS BIGINT) AS reserved_pages,
           CAST(CAST(in_row_used_page_count AS FLOAT) / 128 AS DOUBLE) AS used_mb,
           CAST(CAST(in_row_reserved_page_count AS FLOAT) / 128 AS DOUBLE) AS reserved_mb,
           page_io_latch_wait_count, page_io_latch_wait_in_ms
    FROM index_usage u JOIN databases d ON {_on('u', 'd', 'database_id')}
    JOIN objects o ON {_on('u', 'o', 'database_id', 'object_id')}
    JOIN indexes x ON {_on('u', 'x', 'database_id', 'object_id', 'index_id')}
    JOIN index_operational l ON {_on('u', 'l', 'database_id', 'object_id', 'index_id')}
    JOIN index_physical f ON {_on('l', 'f', 'database_id', 'object_id', 'index_id', 'partition_number')}
    JOIN partition_stats p ON {_on('u', 'p', 'database_id', 'object_id', 'index_id')} AND {pages}""",
    )


_PREFIX = "SQLAgent - TSQL JobStep (Job "
# Job ids of the test binding differ in their first group only, whose bytes
# the agent writes in reverse.
_LABELLED = f"""
    , labelled AS (
        SELECT a.*, coalesce('Job - ' || j.name, a.program_name) AS program
        FROM activity a LEFT JOIN jobs j ON {_on('a', 'j')}
             AND upper(substring(replace(a.program_name, '{_PREFIX}', ''), 1, 34))
                 = '0X' || substring(j.job_id, 7, 2) || substring(j.job_id, 5, 2) || substring(j.job_id, 3, 2)
                   || substring(j.job_id, 1, 2) || '221144335566778899AABBCC')"""
_IN_RANGE = f"collection_time >= TIMESTAMP '{RANGE['start']}' AND collection_time <= TIMESTAMP '{RANGE['end']}'"
_SESSION = f"""{_K}, start_time, collection_time, duration, session_id, blocking_session_id,
           CAST(blocking_session_count AS INTEGER) AS blocking_session_count, cpu, used_memory, reads, writes, login_name,
           database_name, program AS program_name, host_name, wait_info, sql_text, sql_command"""


def _activity(body: str) -> str:
    return _with("activity jobs", _LABELLED + body)


def _per_hour(where: str, name: str) -> str:
    return _activity(
        f""" SELECT {_K}, strftime(collection_time, '%Y-%m-%d %H') AS hour, program, count(*) AS {name}
    FROM labelled WHERE {_IN_RANGE} AND {where} GROUP BY ALL"""
    )


_SESSIONS_PER_PROGRAM = _activity(
    f""" SELECT {_K}, program, host_name, count(*) AS session_count
    FROM labelled WHERE {_IN_RANGE} GROUP BY ALL"""
)
_PAIRED = "p.partition_number = f.partition_number"


def _of_database(sql: str, more: str = "") -> str:
    """The lines of one database."""
    return f"SELECT * FROM ({sql}) WHERE database_name = '{ONE_DATABASE}' {more}"


def _cut(sql: str) -> str:
    """The same over the shorter range."""
    return sql.replace(RANGE["start"], CUT["start"]).replace(RANGE["end"], CUT["end"])


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    # Where tables come from does not show in a report.
    return found | {query: found[name] for query, name in (STORED | APPENDED | ROLLED_UP | LISTED).items()}


def _oracle_sql() -> dict[str, str]:
    return {
        "wait_pareto": _wait_pareto(),
        "latch_pareto": _latch_pareto(),
        "log_search": _log_search(),
        "scheduler_count_by_node": _SCHEDULER_COUNT,
        "scheduler_load": _SCHEDULER_LOAD,
        "cpu_history": _CPU_HISTORY,
        "cpu_by_database": _CPU_BY_DATABASE,
        "top_queries_by_worker_time": _TOP_WORKER,
        "top_queries_by_total_cpu": _top_cpu("total_worker_time"),
        "top_queries_by_avg_cpu": _top_cpu("average_cpu_time"),
        "top_procedures_by_worker_time": _top_procedures(
            "total_worker_time", f"CASE WHEN {_MINUTES} > 0 THEN {_CALLS} END AS calls_per_minute,"
        ),
        "top_procedures_by_logical_reads": _top_procedures(
            "total_logical_reads", f"{_CALLS} AS calls_per_minute,"
        ),
        "top_procedures_by_logical_writes": _top_procedures(
            "total_logical_writes", f"{_CALLS} AS calls_per_minute,", "total_logical_writes > 0"
        ),
        "top_procedures_by_physical_reads": _top_procedures(
            "total_physical_reads",
            "total_logical_reads,",
            "total_physical_reads > 0",
            "total_logical_reads DESC NULLS LAST,",
        ),
        "active_requests": _ACTIVE,
        "head_blockers": _HEADS,
        "active_requests_beyond_bmp": _beyond_bmp(_ACTIVE, False),
        "head_blockers_beyond_bmp": _beyond_bmp(_HEADS, True),
        "top_statements_by_avg_io_beyond_bmp": _beyond_bmp(_TOP_AVG_IO, True),
        "log_segment_count": _SEGMENTS,
        "drive_latency": _DRIVES,
        "io_stalls_by_file": _STALLS,
        "io_by_database": _IO_BY_DATABASE,
        "io_warnings": _log(f"log_generation BETWEEN 0 AND 4 AND log_text ILIKE '%{WARNING_TERM}%'"),
        "volume_space": _VOLUMES,
        "top_statements_by_avg_io": _TOP_AVG_IO,
        "io_profile_by_file": _PROFILE,
        "missing_indexes": _MISSING,
        "unused_indexes": _unused("u.database_id = i.database_id"),
        "unused_indexes_with_untouched": _unused("TRUE"),
        "index_profile": _index_profile(_PAIRED),
        "index_profile_by_partition": _index_profile(_PAIRED),
        "index_profile_crossed": _of_database(_index_profile("TRUE"), f"AND table_name = '{ONE_TABLE}'"),
        "index_profile_of_database": _of_database(_index_profile(_PAIRED)),
        "io_profile_of_database": _of_database(_PROFILE),
        "top_statements_of_database": _of_database(_TOP_AVG_IO),
        "top_procedures_of_database": _of_database(
            _top_procedures("total_logical_reads", f"{_CALLS} AS calls_per_minute,")
        ),
        "unused_indexes_allowed": f"SELECT * FROM ({_unused('u.database_id = i.database_id')}) WHERE database_name IN {ALLOWED}",
        "blocked_per_hour_cut": _cut(_per_hour("blocking_session_id IS NOT NULL", "blocked_count")),
        "sessions_per_program_cut": _cut(_SESSIONS_PER_PROGRAM),
        "activity_latest": _activity(
            f""" SELECT {_SESSION} FROM labelled a
    WHERE collection_time = (SELECT max(b.collection_time) FROM activity b WHERE {_on('b', 'a')})"""
        ),
        "activity_io_offenders": _activity(
            f""" SELECT {_K}, start_time, duration, writes, physical_reads, database_name, program AS program_name,
           host_name, wait_info, sql_text, sql_command FROM labelled WHERE {_IN_RANGE}"""
        ),
        "activity_blocking": _activity(
            f""" SELECT {_SESSION} FROM labelled
    WHERE {_IN_RANGE} AND (blocking_session_id IS NOT NULL OR blocking_session_count <> 0)"""
        ),
        "blocked_per_hour": _per_hour("blocking_session_id IS NOT NULL", "blocked_count"),
        "blocking_per_hour": _per_hour("blocking_session_count <> 0", "blocking_count"),
        "sessions_per_program": _SESSIONS_PER_PROGRAM,
    }
