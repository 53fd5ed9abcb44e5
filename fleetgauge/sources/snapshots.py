"""Reading and writing snapshot tables kept as date-partitioned Parquet."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fleetgauge.sources.schemas import KEYS, NAME_COLUMNS, PARTITION, partition_time, schema

# What is appended or passed over at once: a snapshot's rows of one day.  Only session history has several.
_PART = [*KEYS, PARTITION]
_WRITTEN, _PENDING = "snapshots_written", "snapshots_pending"

# The days each snapshot of the session history has polls on, given to reports beside the history.
LISTED_POLLS = "activity_listed"

# Marks a partition column that was derived from its table's time.
DERIVED = "derived"


def _columns(table: str) -> list[str]:
    return [f"`{c}`" for c in schema(table).names]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring a frame to the declared columns and types of ``table``.

    ``collected_date`` is always derived: readers rely on it.
    """
    derived = {PARTITION: partition_time(table)}
    out = df.selectExpr(
        *(
            f"CAST(`{derived.get(f.name, f.name)}` AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in schema(table).fields
        )
    )
    return out.withMetadata(PARTITION, {DERIVED: True})


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    first_date: dt.date | None = None,
    last_date: dt.date | None = None,
    servers: Iterable[str] | None = None,
) -> DataFrame:
    """Snapshots of one table, both dates inclusive.

    The dates filter the partition column, so files outside them are never
    opened; the server filter is pushed to the Parquet scan.
    """
    return filtered(spark.read.schema(schema(table)).parquet(f"{root}/{table}"), table, first_date, last_date, servers)


def filtered(
    df: DataFrame,
    table: str,
    first_date: dt.date | None = None,
    last_date: dt.date | None = None,
    servers: Iterable[str] | None = None,
) -> DataFrame:
    """Snapshots of a stored table, with the filters of :func:`read_table`."""
    # Parquet puts the partition column last; bring it back to its place.
    df = df.select(*_columns(table)).withMetadata(PARTITION, {DERIVED: True})
    return with_filters(df, first_date, last_date, servers)


def with_filters(
    df: DataFrame, first_date: dt.date | None, last_date: dt.date | None, servers: Iterable[str] | None
) -> DataFrame:
    """Rows of some days, both inclusive, and servers."""
    if first_date is not None:
        df = df.where(F.col(PARTITION) >= F.lit(first_date))
    if last_date is not None:
        df = df.where(F.col(PARTITION) <= F.lit(last_date))
    if servers is not None:
        df = df.where(F.col("server_name").isin(*servers))
    return df


def read_tables(
    spark: SparkSession,
    root: str,
    tables: Iterable[str],
    first_date: dt.date | None = None,
    last_date: dt.date | None = None,
    servers: Iterable[str] | None = None,
    undated: Iterable[str] = (),
) -> dict[str, DataFrame]:
    """Several snapshot tables under the same filters.

    Dates do not apply to ``undated`` tables.  They are the ones a report looks
    things up in while its dates are those of another event than the capture.
    """
    undated = set(undated)
    dates = {"first_date": first_date, "last_date": last_date}
    return {t: read_table(spark, root, t, servers=servers, **({} if t in undated else dates)) for t in tables}


def dated(df: DataFrame, time: str) -> DataFrame:
    """``df`` with the partition column that belongs to ``time``.

    Stored and conformed tables keep theirs, which prunes files; in any other
    frame it could be another day's, so it is computed anew.
    """
    if PARTITION in df.columns and df.schema[PARTITION].metadata.get(DERIVED):
        return df
    return df.withColumn(PARTITION, F.expr(f"CAST({time} AS DATE)"))


def with_collation(tables: Mapping[str, DataFrame], collation: str = "UTF8_LCASE_RTRIM") -> dict[str, DataFrame]:
    """The same tables with names compared as most servers do: no case, no trailing blanks."""
    return {
        table: df.withColumns(
            {c: F.expr(f"CAST({c} AS STRING COLLATE {collation})") for c in NAME_COLUMNS.get(table, ())}
        )
        if table in NAME_COLUMNS
        else df
        for table, df in tables.items()
    }


def read_optional(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """A stored frame, or an empty one where nothing is stored yet."""
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def _matching(df: DataFrame, other: DataFrame, columns: Iterable[str], how: str) -> DataFrame:
    """Rows of ``df`` with (``left_semi``) or without (``left_anti``) a row of ``other`` that agrees, NULL with NULL."""
    other = other.select(*(F.col(c).alias(f"other_{c}") for c in columns))
    same = [df[c].eqNullSafe(other[f"other_{c}"]) for c in columns]
    return df.join(other, same, how)


def _days(parts: DataFrame) -> list[dt.date | None]:
    """Days of some snapshots: a list as long as the calendar at most, by which files are pruned."""
    return [r[PARTITION] for r in parts.select(PARTITION).distinct().collect()]


def _on_days(df: DataFrame, days: list[dt.date | None], on: bool = True) -> DataFrame:
    known = F.col(PARTITION).isin([d for d in days if d is not None])
    among = F.coalesce(known, F.lit(False)) | (F.col(PARTITION).isNull() if None in days else F.lit(False))
    return df.where(among if on else ~among)


def written_parts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Snapshots, by day, that were appended whole: ``server_name, collected_at, collected_date``."""
    return read_optional(spark, f"{root}/{_WRITTEN}/{table}", StructType([schema(table)[c] for c in _PART])).select(*_PART)


def append_table(df: DataFrame, root: str, table: str) -> None:
    """Append the snapshots of one table that are not stored yet, partitioned by collection date.

    A snapshot counts as stored once it is listed in ``snapshots_written``,
    which happens after its rows are.  So the same append can be repeated, also
    after one that failed: listed snapshots are passed over, and rows that a
    failed append left behind are replaced.  Only the days of ``df`` are read,
    by three columns; days that hold such rows are written anew, whole.

    ``df`` is read twice: for its snapshots and for its rows.  Two writers must
    not append the same snapshot at the same time.
    """
    spark, path = df.sparkSession, f"{root}/{table}"
    out = conform(df, table)
    pending = f"{root}/{_PENDING}/{table}/{uuid.uuid4().hex}"
    part = StructType([schema(table)[c] for c in _PART])

    def noted(parts: DataFrame, name: str) -> DataFrame:
        """Parts as they are now, whatever is written later."""
        parts.distinct().write.parquet(f"{pending}/{name}")
        return spark.read.schema(part).parquet(f"{pending}/{name}")

    new = noted(_matching(out.select(*_PART), written_parts(spark, root, table), _PART, "left_anti"), "new")
    if new.isEmpty():
        return

    rows = _matching(out, new, _PART, "left_semi").select(*_columns(table))
    stored = _on_days(read_optional(spark, path, schema(table)).select(*_columns(table)), _days(new))
    left = noted(_matching(stored.select(*_PART), new, _PART, "left_semi"), "left")
    if left.isEmpty():
        _write(rows, path, "append")
    else:
        days = _days(left)
        whole = _matching(_on_days(stored, days), left, _PART, "left_anti")
        # Days with rows of a failed append get new rows as well, so none of them is left as it is.
        _write(whole.union(_on_days(rows, days)), path, "overwrite")
        _write(_on_days(rows, days, False), path, "append")
    new.coalesce(1).write.mode("append").partitionBy(PARTITION).parquet(f"{root}/{_WRITTEN}/{table}")


def write_days(rows: DataFrame, path: str) -> None:
    """Replace the days that ``rows`` has, and leave the others alone."""
    _write(rows, path, "overwrite")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """``rebalance`` lets adaptive execution cut a large day into several files and merge small ones."""
    out = rows.hint("rebalance", PARTITION).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    out.partitionBy(PARTITION).parquet(path)


def write_table(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Store snapshots of one table, partitioned by collection date.

    ``append`` passes over snapshots that are stored (:func:`append_table`).
    ``overwrite`` replaces the days that ``df`` has rows of, with all their
    snapshots, and leaves the other days alone.
    """
    if mode == "append":
        append_table(df, root, table)
        return
    if mode != "overwrite":
        raise ValueError(f"unknown mode: {mode}")
    out, written = conform(df, table), f"{root}/{_WRITTEN}/{table}"
    _write(out, f"{root}/{table}", "overwrite")
    parts = out.select(*_PART).distinct().coalesce(1)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(written)
