"""Storage: log fragmentation, drives, files, volumes, statements by I/O."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.arithmetic import decimal, half_up_ratio, int_div, int_div_or_zero, percent_of
from fleetgauge.functions.text import statement_slice
from fleetgauge.operators.lookup import in_databases, with_database_name, with_object_name
from fleetgauge.operators.ranking import ordering, share_rank, top_k
from fleetgauge.plans.cpu import STATEMENT_ID, per_execution, search_log, text_owners, texts_of
from fleetgauge.sources.schemas import KEYS

# Message of a stalled I/O request, and sizes.
SLOW_IO_TERM = "taking longer than 15 seconds"
MB = 1024 * 1024
GB = 1024 * MB
PAGES_PER_MB = 128

_FILE = [*KEYS, "database_id", "file_id"]


def log_segment_count(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Virtual log files per database, 0 where there are none."""
    counts = tables["log_segments"].groupBy(*KEYS, "database_name").agg(F.expr("count(*) AS segments"))
    return (
        tables["databases"]
        .selectExpr(*KEYS, "name AS database_name")
        .join(counts, [*KEYS, "database_name"], "left")
        .selectExpr(*KEYS, "database_name", "coalesce(segments, 0) AS segment_count")
        .orderBy(*KEYS, F.desc("segment_count"), "database_name")
    )


def drive_latency(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Latency and transfer size per drive and mount point."""
    files = tables["files"].selectExpr(*_FILE, "left(upper(physical_name), 2) AS drive")
    volumes = tables["volumes"].select(*_FILE, "volume_mount_point")
    drives = (
        tables["file_io"]
        .join(files, _FILE)
        .join(volumes, _FILE)
        .groupBy(*KEYS, "drive", "volume_mount_point")
        .agg(
            F.sum("num_of_reads").alias("reads"),
            F.sum("num_of_writes").alias("writes"),
            F.sum("io_stall_read_ms").alias("read_stall"),
            F.sum("io_stall_write_ms").alias("write_stall"),
            F.sum("io_stall").alias("stall"),
            F.sum("num_of_bytes_read").alias("read_bytes"),
            F.sum("num_of_bytes_written").alias("write_bytes"),
        )
    )
    return drives.selectExpr(
        *KEYS,
        "drive",
        "volume_mount_point",
        f"{int_div_or_zero('read_stall', 'reads')} AS read_latency",
        f"{int_div_or_zero('write_stall', 'writes')} AS write_latency",
        f"{int_div_or_zero('stall', 'reads + writes')} AS overall_latency",
        f"{int_div_or_zero('read_bytes', 'reads')} AS avg_bytes_per_read",
        f"{int_div_or_zero('write_bytes', 'writes')} AS avg_bytes_per_write",
        f"{int_div_or_zero('read_bytes + write_bytes', 'reads + writes')} AS avg_bytes_per_transfer",
    ).orderBy(*KEYS, F.desc("overall_latency"), "drive", "volume_mount_point")


def io_stalls_by_file(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Average stall per read, write and request of every file.

    Denominators carry +1, so an idle file reads as 0 instead of failing.
    """
    files = tables["files"].select(*_FILE, "physical_name", "type_desc", "size")
    stalls = tables["file_io"].selectExpr(
        "*",
        "io_stall_read_ms + io_stall_write_ms AS io_stalls",
        "num_of_reads + num_of_writes AS total_io",
    )
    return (
        with_database_name(stalls.join(files, _FILE), tables["databases"])
        .selectExpr("*", f"{half_up_ratio('io_stalls', 'total_io + 1', 1)} AS avg_io_stall_ms")
        .orderBy(*KEYS, F.desc("avg_io_stall_ms"), "database_id", "file_id")
        .selectExpr(
            *KEYS,
            "database_name",
            f"{half_up_ratio('io_stall_read_ms', 'num_of_reads + 1', 1)} AS avg_read_stall_ms",
            f"{half_up_ratio('io_stall_write_ms', 'num_of_writes + 1', 1)} AS avg_write_stall_ms",
            "avg_io_stall_ms",
            f"{half_up_ratio('size', PAGES_PER_MB, 2)} AS file_size_mb",
            "physical_name",
            "type_desc",
            "io_stall_read_ms",
            "num_of_reads",
            "io_stall_write_ms",
            "num_of_writes",
            "io_stalls",
            "total_io",
        )
    )


def io_by_database(tables: Mapping[str, DataFrame], strategy: str = "plain") -> DataFrame:
    """Bytes moved per database in whole MB, rank and share.

    Ranked in one task per snapshot for the reason given at ``cpu_by_database``.
    """
    by_database = (
        tables["file_io"]
        .groupBy(*KEYS, "database_id")
        .agg(F.expr("sum(num_of_bytes_read + num_of_bytes_written) AS bytes"))
        .selectExpr(*KEYS, "database_id", f"{int_div('bytes', MB)} AS io_mb")
    )
    ranked = share_rank(by_database, "io_mb", ["database_id"], strategy=strategy)
    return (
        with_database_name(ranked, tables["databases"])
        .selectExpr(
            *KEYS,
            "row_rank AS io_rank",
            "database_name",
            f"{decimal('io_mb', 2)} AS total_io_mb",
            "share AS io_percent",
        )
        .orderBy(*KEYS, "io_rank")
    )


def io_warnings(
    tables: Mapping[str, DataFrame],
    generations: Sequence[int] = (0, 1, 2, 3, 4),
    term: str = SLOW_IO_TERM,
) -> DataFrame:
    """Slow-I/O messages of the most recent logs, newest first."""
    return search_log(tables, [term], generations, newest_first=True)


def volume_space(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Size and free space of the volumes that hold database files."""
    return (
        tables["volumes"]
        .join(tables["files"].select(*_FILE), _FILE, "left_semi")
        .selectExpr(
            *KEYS,
            "volume_mount_point",
            "file_system_type",
            "logical_volume_name",
            f"{half_up_ratio('total_bytes', GB, 2)} AS total_gb",
            f"{half_up_ratio('available_bytes', GB, 2)} AS available_gb",
            f"{percent_of('available_bytes', 'total_bytes', 2)} AS free_percent",
        )
        .distinct()
        .orderBy(*KEYS, "volume_mount_point", "file_system_type", "logical_volume_name", "total_gb", "available_gb")
    )


def top_statements_by_avg_io(
    tables: Mapping[str, DataFrame], database: str | None = None, k: int = 50
) -> DataFrame:
    """Statements of a database with the most logical I/O per execution.

    Without a ``database`` every database gets its own top ``k``.
    """
    owned = in_databases(text_owners(tables, "sql_handle"), tables["databases"], database, "dbid")
    stats = tables["query_stats"].selectExpr(
        *KEYS, *STATEMENT_ID, "execution_count", f"{per_execution('total_logical_reads + total_logical_writes')} AS avg_io"
    )
    winners = top_k(
        stats.join(owned, [*KEYS, "sql_handle"]), ["avg_io"], STATEMENT_ID, k, group=[*KEYS, "dbid"]
    )
    statement = statement_slice("text", "statement_start_offset", "statement_end_offset", "legacy")
    return (
        with_object_name(winners, tables["objects"])
        .join(texts_of(tables, winners, "sql_handle"), [*KEYS, "sql_handle"])
        .orderBy(*KEYS, "dbid", *ordering(["avg_io"], STATEMENT_ID))
        .selectExpr(
            *KEYS,
            "database_name",
            "bare_name AS sp_name",
            "avg_io",
            "execution_count",
            f"{statement} AS query_text",
        )
    )


def io_profile_by_file(tables: Mapping[str, DataFrame], database: str | None = None) -> DataFrame:
    """Read and write profile of the files of a database, or of every database."""
    files = tables["db_files"].selectExpr(*_FILE, "name AS logical_name", "type_desc", "physical_name")
    stall = "io_stall_read_ms + io_stall_write_ms"
    requests = "num_of_reads + num_of_writes"
    moved = "num_of_bytes_read + num_of_bytes_written"
    return in_databases(tables["file_io"].join(files, _FILE), tables["databases"], database).selectExpr(
        *KEYS,
        "database_name",
        "logical_name",
        "file_id",
        "type_desc",
        "physical_name",
        f"{half_up_ratio('size_on_disk_bytes', MB, 2)} AS size_on_disk_mb",
        "num_of_reads",
        "num_of_writes",
        "io_stall_read_ms",
        "io_stall_write_ms",
        f"{percent_of('io_stall_read_ms', stall, 1)} AS io_stall_reads_pct",
        f"{percent_of('io_stall_write_ms', stall, 1)} AS io_stall_writes_pct",
        f"{requests} AS total_io",
        f"{half_up_ratio('num_of_bytes_read', MB, 2)} AS mb_read",
        f"{half_up_ratio('num_of_bytes_written', MB, 2)} AS mb_written",
        f"{percent_of('num_of_reads', requests, 1)} AS reads_pct",
        f"{percent_of('num_of_writes', requests, 1)} AS writes_pct",
        f"{percent_of('num_of_bytes_read', moved, 1)} AS read_bytes_pct",
        f"{percent_of('num_of_bytes_written', moved, 1)} AS written_bytes_pct",
    )
