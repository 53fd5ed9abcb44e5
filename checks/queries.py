"""Every report bound to the test tables.

Reports that take a database or table name run without one, that is over
every database and table; time ranges cover the whole history.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType, FloatType

from fleetgauge import REPORTS, report, report_over
from fleetgauge.sources.adapters import telemetry
from fleetgauge.sources.buckets import LAYOUT, write_bucketed
from fleetgauge.sources.rollups import roll_up
from fleetgauge.sources.scratch import shared_folder
from fleetgauge.sources.snapshots import write_table

RANGE = {"start": "2024-01-01 00:00:00", "end": "2024-01-31 00:00:00"}
LOG_TERMS = ("the", "and")
WARNING_TERM = "of the"
OWN_SESSIONS = (7,)

# Query -> (report, parameters).  Reports are registered under their own name;
# those with parameters worth telling apart under several.
BINDINGS: dict[str, tuple[str, dict]] = {name: (name, {}) for name in REPORTS if name != "top_procedures"}
BINDINGS["log_search"] = ("log_search", {"terms": LOG_TERMS})
BINDINGS["io_warnings"] = ("io_warnings", {"term": WARNING_TERM})
BINDINGS["active_requests"] = ("active_requests", {"exclude_sessions": OWN_SESSIONS})
BINDINGS["unused_indexes_with_untouched"] = ("unused_indexes", {"include_never_touched": True})
BINDINGS["index_profile_by_partition"] = ("index_profile", {"match_partition": True})
# Forms for one database or table, an allow-list, and a range that cuts on both ends: there the parameter is the point.
ONE_DATABASE, ONE_TABLE = "NATION_7", "red bolt 29"
ALLOWED = ("NATION_1", "NATION_2", "NATION_11")
CUT = {"start": "2024-01-05 10:20:30", "end": "2024-01-20 21:10:05"}
BINDINGS["index_profile_crossed"] = (
    "index_profile", {"match_partition": False, "database": ONE_DATABASE, "table": ONE_TABLE}
)
BINDINGS["index_profile_of_database"] = ("index_profile", {"database": ONE_DATABASE})
BINDINGS["io_profile_of_database"] = ("io_profile_by_file", {"database": ONE_DATABASE})
BINDINGS["top_statements_of_database"] = ("top_statements_by_avg_io", {"database": ONE_DATABASE})
BINDINGS["top_procedures_of_database"] = ("top_procedures", {"metric": "logical_reads", "database": ONE_DATABASE})
BINDINGS["unused_indexes_allowed"] = ("unused_indexes", {"allowed_databases": ALLOWED})
BINDINGS["blocked_per_hour_cut"] = ("blocked_per_hour", CUT)
BINDINGS["sessions_per_program_cut"] = ("sessions_per_program", CUT)
for metric in ("worker_time", "logical_reads", "logical_writes", "physical_reads"):
    BINDINGS[f"top_procedures_by_{metric}"] = ("top_procedures", {"metric": metric})
for ranged in (
    "activity_io_offenders",
    "activity_blocking",
    "blocked_per_hour",
    "blocking_per_hour",
    "sessions_per_program",
):
    BINDINGS[ranged] = (ranged, RANGE)


# Texts with characters of two UTF-16 units, ahead of the statement and inside it.
BEYOND_BMP = {"text": "concat('\U0001f600', left(text, 5), '\U0001f600\U0001d11e', substring(text, 6))"}
EDITS: dict[str, dict[str, dict[str, str]]] = {}
for sliced in ("active_requests", "head_blockers", "top_statements_by_avg_io"):
    BINDINGS[f"{sliced}_beyond_bmp"] = BINDINGS[sliced]
    EDITS[f"{sliced}_beyond_bmp"] = {"sql_text": BEYOND_BMP}


def run(query: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over the test tables, in the report's own types."""
    name, params = BINDINGS[query]
    tables = telemetry(spark, sf_dir, REPORTS[name].tables)
    for table, columns in EDITS.get(query, {}).items():
        tables[table] = tables[table].withColumns({c: F.expr(e) for c, e in columns.items()})
    return report(name, tables, **params)


# Reports over tables that are stored first: by bucket, or as snapshots that are appended twice, by a retried capture.
STORED = {f"{name}_bucketed": name for name in ("index_profile", "unused_indexes", "drive_latency", "io_profile_by_file")}
APPENDED = {f"{name}_appended_twice": name for name in ("wait_pareto", "blocked_per_hour", "io_by_database")}
ROLLED_UP = {f"{name}_rolled_up": name for name in ("blocked_per_hour", "blocking_per_hour", "sessions_per_program_cut")}
LISTED = {"activity_latest_listed": "activity_latest"}
BUCKETS = 8


def run_stored(query: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over stored tables, in the report's own types."""
    name, params = BINDINGS[(STORED | APPENDED | ROLLED_UP | LISTED)[query]]
    root = f"{shared_folder(spark)}/fleet-{uuid.uuid4().hex}"
    for table, df in telemetry(spark, sf_dir, REPORTS[name].tables).items():
        if query in STORED and table in LAYOUT:
            write_bucketed(df, root, table, BUCKETS)
        else:
            for _ in range(2 if query in APPENDED else 1):
                write_table(df, root, table)
    if query in ROLLED_UP:
        roll_up(spark, root)
    layout = {"buckets": BUCKETS if query in STORED else None, "rollups": query in ROLLED_UP, "listed": query in LISTED}
    return report_over(spark, root, name, **layout, **params)


def comparable(df: DataFrame) -> DataFrame:
    """Decimals and floats as doubles, the one fraction type both engines share."""
    fractions = (DecimalType, FloatType)
    return df.selectExpr(
        *(f"CAST({f.name} AS DOUBLE) AS {f.name}" if isinstance(f.dataType, fractions) else f.name for f in df.schema)
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: str, how) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: comparable(how(query, spark, sf_dir))

    return {q: bind(q, run) for q in BINDINGS} | {q: bind(q, run_stored) for q in (*STORED, *APPENDED, *ROLLED_UP, *LISTED)}
