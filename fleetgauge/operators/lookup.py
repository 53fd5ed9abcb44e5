"""Joins of facts with the catalog and job dimensions.

No side is broadcast by hint: Spark broadcasts a side whose measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, where
adaptive execution splits a hot key over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.text import JOB_LABEL, job_key_of_program, job_key_of_uuid, literal
from fleetgauge.sources.schemas import KEYS, PARTITION

# Rows without a key are dealt out over this many join keys.
_SPREAD = 4096
# Fixed value: no server stores an earlier time.
_FIRST_TIME = "TIMESTAMP_NTZ'1753-01-01 00:00:00'"


def with_database_name(
    df: DataFrame, databases: DataFrame, id_column: str = "database_id", name: str = "database_name"
) -> DataFrame:
    """Add the name of a database, NULL for an unknown id."""
    names = databases.selectExpr(*KEYS, f"database_id AS {id_column}", f"name AS {name}")
    return df.join(names, [*KEYS, id_column], "left")


def with_object_name(
    df: DataFrame, objects: DataFrame, database_id: str = "dbid", object_id: str = "objectid"
) -> DataFrame:
    """Add ``schema_name`` and ``bare_name`` of an object, NULL for an unknown id."""
    names = objects.selectExpr(
        *KEYS, f"database_id AS {database_id}", f"object_id AS {object_id}", "schema_name", "name AS bare_name"
    )
    return df.join(names, [*KEYS, database_id, object_id], "left")


def in_databases(
    df: DataFrame, databases: DataFrame, database: str | None, id_column: str = "database_id"
) -> DataFrame:
    """Keep the rows of one named database, or of every known one, and add its name.

    Object, file and index ids are only unique inside a database, and servers
    number their databases differently, so a name is resolved per snapshot.
    """
    if database is not None:
        databases = databases.where(f"name = {literal(database)}")
    known = databases.selectExpr(*KEYS, f"database_id AS {id_column}", "name AS database_name")
    return df.join(known, [*KEYS, id_column])


def left_join_sparse(df: DataFrame, dimension: DataFrame, key: str, row_id: Sequence[str]) -> DataFrame:
    """Left join on the fleet keys and ``key``, which many rows of ``df`` do not have.

    A missing key finds nothing wherever the row is, so those rows are dealt
    out by a hash of ``row_id`` instead of meeting in one task.
    """
    spread = f"IF({key} IS NULL, 1 + pmod(xxhash64({', '.join(row_id)}), {_SPREAD}), 0) AS spread"
    found = dimension.selectExpr("*", "CAST(0 AS BIGINT) AS spread")
    return df.selectExpr("*", spread).join(found, [*KEYS, key, "spread"], "left").drop("spread")


def with_program_label(df: DataFrame, jobs: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Add ``program_label``: ``Job - <name>`` where the program name carries a job's key.

    Anything else, also a job without a name, keeps its program name.  Most
    sessions are not jobs; they get join keys that no job has, dealt out by a
    hash of ``row_id``, so that they do not all meet in one task.
    """
    no_job = f"concat('-', CAST(pmod(xxhash64({', '.join(row_id)}), {_SPREAD}) AS STRING))"
    keyed = df.selectExpr("*", f"coalesce({job_key_of_program('program_name')}, {no_job}) AS job_key")
    labels = jobs.selectExpr(
        *KEYS, f"{job_key_of_uuid('job_id')} AS job_key", f"concat({literal(JOB_LABEL)}, name) AS job_label"
    )
    return keyed.join(labels, [*KEYS, "job_key"], "left").selectExpr(
        "*", "coalesce(job_label, program_name) AS program_label"
    )


def at_latest(df: DataFrame, time: str, listed: DataFrame | None = None) -> DataFrame:
    """Rows whose ``time`` is the newest of their snapshot.

    ``time`` must be the column the table is partitioned by.  The newest times
    are found on two narrow columns; joined on the partition column too, they
    keep the wide scan to the files of those days.  ``listed`` names the days
    each snapshot has rows on (``server_name, collected_at, collected_date``):
    with it the newest times are looked for on each snapshot's last day only,
    so what is read does not grow with the history.
    """
    if listed is not None:
        last = listed.groupBy(*KEYS).agg(F.max(PARTITION).alias(PARTITION))
        # As many days as the calendar has at most; a subquery over them prunes both scans, broadcast or not.
        days = last.agg(F.collect_set(PARTITION)).scalar()
        df = df.where(F.array_contains(days, F.col(PARTITION)))
    newest = (
        df.groupBy(*KEYS)
        .agg(F.max(time).alias(time))
        # Spark prunes partitions through a join only if the pruning side is
        # filtered by a comparison.  This one holds for every time there is.
        .where(f"{time} >= {_FIRST_TIME}")
        .selectExpr(*KEYS, time, f"CAST({time} AS DATE) AS {PARTITION}")
    )
    return df.join(newest, [*KEYS, PARTITION, time], "left_semi")
