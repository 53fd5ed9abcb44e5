"""Snapshot tables stored by bucket, so that their joins need no exchange.

Tables of index and file facts are written in buckets of the columns that all
their joins share: the snapshot, the database, and the object or file.  Rows
that join are then in the same bucket of every table, and a task joins one
bucket of each as it reads them.

A bucket holds a hash's share of all objects of all captures, so no key can
fill one unless a single object of one capture does.  The number of buckets
is part of the folder's name: a reader that expects another number finds no
table, instead of wrong rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.sources.schemas import KEYS, PARTITION, schema
from fleetgauge.sources.snapshots import conform, filtered, read_table

BUCKETS = 256
_BY_OBJECT = [*KEYS, "database_id", "object_id"]
_BY_FILE = [*KEYS, "database_id", "file_id"]
# Columns of the buckets, and what rows are sorted by within one.
LAYOUT: dict[str, tuple[list[str], list[str]]] = {
    "objects": (_BY_OBJECT, []),
    "indexes": (_BY_OBJECT, ["index_id"]),
    "index_usage": (_BY_OBJECT, ["index_id"]),
    "partition_stats": (_BY_OBJECT, ["index_id", "partition_number"]),
    "index_operational": (_BY_OBJECT, ["index_id", "partition_number"]),
    "index_physical": (_BY_OBJECT, ["index_id", "partition_number"]),
    "file_io": (_BY_FILE, []),
    "files": (_BY_FILE, []),
    "db_files": (_BY_FILE, []),
    "volumes": (_BY_FILE, []),
}
# A join on more columns than the buckets' may use the buckets.
CO_LOCATED = "spark.sql.requireAllClusterKeysForCoPartition"


def bucketed_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which joins on more than the buckets' columns keep to the buckets.

    Elsewhere that is not wanted: few, hot keys would be joined where they happen to be.
    """
    session = spark.newSession()
    for key in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set(CO_LOCATED, "false")
    return session


def _path(root: str, table: str, buckets: int) -> str:
    return f"{root}/bucketed-{buckets}/{table}"


def _registered(spark: SparkSession, root: str, table: str, buckets: int) -> str:
    """Name of the stored table in the session's catalog, which is where Spark looks for buckets."""
    path = _path(root, table, buckets)
    name = f"bucketed_{hashlib.md5(path.encode()).hexdigest()}_{table}"
    by, further = LAYOUT[table]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema(table))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({PARTITION}) "
        f"CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join([*by, *further])}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def write_bucketed(df: DataFrame, root: str, table: str, buckets: int = BUCKETS) -> None:
    """Store snapshots of one table by bucket, replacing the days that ``df`` has rows of.

    One shuffle at writing takes the place of one for every join at reading.
    Writing the same days again changes nothing.
    """
    spark = df.sparkSession
    name = _registered(spark, root, table, buckets)
    rows = conform(df, table)
    # Spark's buckets are its hash partitions: each task writes one bucket of every day, as one file.
    dealt = rows.repartition(buckets, *LAYOUT[table][0]).select(*(f"`{c}`" for c in spark.table(name).columns))
    mode = "spark.sql.sources.partitionOverwriteMode"  # not an option of this writer
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        dealt.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)


def bucket_days(
    spark: SparkSession,
    root: str,
    tables: Iterable[str] = tuple(LAYOUT),
    first_date: dt.date | None = None,
    last_date: dt.date | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Store whole days of appended snapshots by bucket as well, as a nightly job would."""
    for table in tables:
        write_bucketed(read_table(spark, root, table, first_date, last_date), root, table, buckets)


def read_bucketed(
    spark: SparkSession,
    root: str,
    tables: Iterable[str],
    first_date: dt.date | None = None,
    last_date: dt.date | None = None,
    servers: Iterable[str] | None = None,
    buckets: int = BUCKETS,
) -> dict[str, DataFrame]:
    """Stored tables, both dates inclusive; ``spark`` is best a :func:`bucketed_session`."""
    found = {}
    for table in tables:
        name = _registered(spark, root, table, buckets)
        # Days that other sessions wrote.
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        spark.catalog.refreshTable(name)
        found[table] = filtered(spark.table(name), table, first_date, last_date, servers)
    return found
