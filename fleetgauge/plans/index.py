"""Indexes: missing, unused, and the profile of those of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fleetgauge.functions.arithmetic import decimal, int_div
from fleetgauge.functions.text import last_name_part, literal, one_of
from fleetgauge.operators.lookup import in_databases
from fleetgauge.operators.ranking import ordering, top_k
from fleetgauge.sources.schemas import KEYS, PARTITION

# Index kind that is a candidate for removal, prefix (followed by
# any one character) of names that are not, state of a database that can be
# read, page size in KB.
NONCLUSTERED = 2
PRIMARY_KEY_PREFIX = "PK"
ONLINE = "ONLINE"
PAGE_KB = 8

_OBJECT = [*KEYS, "database_id", "object_id"]
_INDEX = [*_OBJECT, "index_id"]


def missing_indexes(tables: Mapping[str, DataFrame], k: int = 50) -> DataFrame:
    """Indexes the servers asked for, by estimated advantage.

    The CREATE INDEX text is data for a person to read; nothing runs it.
    """
    stats = tables["mi_group_stats"].selectExpr(
        *KEYS,
        "group_handle AS index_group_handle",
        f"{decimal('user_seeks * avg_total_user_cost * (avg_user_impact * 0.01D)', 2)} AS index_advantage",
        "avg_user_impact AS user_impact",
        f"{decimal('avg_total_user_cost', 2)} AS avg_cost",
        "user_seeks AS seeks",
        "last_user_seek AS last_seek",
    )
    groups = tables["mi_groups"].select(*KEYS, "index_group_handle", "index_handle")
    details = tables["mi_details"].select(
        *KEYS, "index_handle", "statement", "equality_columns", "inequality_columns", "included_columns"
    )
    asked = stats.join(groups, [*KEYS, "index_group_handle"]).join(details, [*KEYS, "index_handle"])
    entity = ["index_group_handle", "index_handle"]
    create = f"""concat('CREATE INDEX [missing_index_', index_group_handle, '_', index_handle, '_',
        left({last_name_part('statement')}, 32), '] ON ', statement, ' (', coalesce(equality_columns, ''),
        CASE WHEN equality_columns IS NOT NULL AND inequality_columns IS NOT NULL THEN ',' ELSE '' END,
        coalesce(inequality_columns, ''), ')', coalesce(concat(' INCLUDE (', included_columns, ')'), ''))"""
    return (
        top_k(asked, ["index_advantage"], entity, k)
        .orderBy(*KEYS, *ordering(["index_advantage"], entity))
        .selectExpr(
            *KEYS,
            "index_advantage",
            "user_impact",
            "avg_cost",
            "seeks",
            "statement AS table_name",
            "coalesce(equality_columns, '') AS equality_columns",
            "coalesce(inequality_columns, '') AS inequality_columns",
            "coalesce(included_columns, '') AS included_columns",
            "last_seek",
            f"{create} AS create_index_statement",
        )
    )


def unused_indexes(
    tables: Mapping[str, DataFrame],
    allowed_databases: Sequence[str] | None = None,
    include_never_touched: bool = False,
) -> DataFrame:
    """Plain indexes that cost updates and serve no reads.

    Only online databases count, and of them the allowed ones when a list is
    given.  An index without a usage row has not been touched since the server
    started; it is left out unless ``include_never_touched``.  Tables of the
    same name in two schemas are one line when index and usage agree.  The DROP
    INDEX text is data for a person to read; nothing runs it.
    """
    databases = tables["databases"].where(f"state_desc = {literal(ONLINE)}")
    if allowed_databases is not None:
        databases = databases.where(one_of("name", allowed_databases))
    prefix = len(PRIMARY_KEY_PREFIX)
    candidates = (
        tables["indexes"]
        .where(f"type = {NONCLUSTERED} AND NOT is_unique")
        # Not LIKE, which Spark has for some collations only.
        .where(f"NOT (left(name, {prefix}) = {literal(PRIMARY_KEY_PREFIX)} AND length(name) > {prefix})")
        .selectExpr(*_INDEX, "name AS index_name")
    )
    usage = tables["index_usage"].selectExpr(
        *_INDEX, "user_seeks AS seeks", "user_scans AS scans", "user_lookups AS lookups", "user_updates AS updates"
    )
    objects = tables["objects"].selectExpr(*_OBJECT, "name AS table_view")
    # One row per index, whatever the number of its partitions.
    pages = tables["partition_stats"].groupBy(*_INDEX).agg(F.sum("used_page_count").alias("pages"))

    unused = (
        candidates.join(usage, _INDEX, "left" if include_never_touched else "inner")
        .fillna(0, ["seeks", "scans", "lookups", "updates"])
        .where("seeks = 0 AND scans = 0 AND lookups = 0")
    )
    lines = (
        in_databases(unused.join(pages, _INDEX, "left"), databases, None)
        .join(objects, _OBJECT)
        .groupBy(*KEYS, "database_name", "table_view", "index_name", "seeks", "scans", "lookups", "updates")
        .agg(F.expr(f"coalesce(sum(pages) * {PAGE_KB}, 0) AS size_kb"))
    )
    drop = "concat('DROP INDEX [', index_name, '] ON [', database_name, '].[dbo].[', table_view, '] WITH ( ONLINE = OFF )')"
    return lines.orderBy(
        *KEYS, F.desc("size_kb"), "database_name", "table_view", "index_name", "updates"
    ).selectExpr(
        *KEYS,
        "database_name",
        "table_view",
        "index_name",
        "seeks",
        "scans",
        "lookups",
        "updates",
        f"{int_div('size_kb', 1024)} AS index_size_mb",
        f"{drop} AS drop_index_statement",
    )


def index_profile(
    tables: Mapping[str, DataFrame],
    database: str | None = None,
    table: str | None = None,
    match_partition: bool = True,
) -> DataFrame:
    """Usage, locking, fragmentation and size of the indexes of a table.

    Without ``database`` or ``table`` every one is covered.  The scripts join
    page counts per index, not per partition, so an index with n partitions
    gives n x n lines.  That form, ``match_partition=False``, is there for one
    table of one database only.
    """
    if not match_partition and (database is None or table is None):
        raise ValueError("every partition with every other: name one database and one table")
    objects = tables["objects"].selectExpr(*_OBJECT, "name AS table_name")
    if table is not None:
        objects = objects.where(f"table_name = {literal(table)}")
    indexes = tables["indexes"].selectExpr(
        *_INDEX,
        "name AS index_name",
        "type_desc",
        "allow_row_locks",
        "allow_page_locks",
        "fill_factor",
        "is_padded",
    )
    by_partition = [*_INDEX, "partition_number"]
    page_key = by_partition if match_partition else _INDEX
    # Single precision, like the counter this has always been quoted in.
    pages = tables["partition_stats"].selectExpr(
        *page_key,
        "in_row_used_page_count AS used_pages",
        "in_row_reserved_page_count AS reserved_pages",
        "CAST(CAST(in_row_used_page_count AS FLOAT) * 8192 / 1024 / 1024 AS FLOAT) AS used_mb",
        "CAST(CAST(in_row_reserved_page_count AS FLOAT) * 8192 / 1024 / 1024 AS FLOAT) AS reserved_mb",
    )
    reads = "user_scans + user_seeks + user_lookups"
    # Names go to the indexes; partitions, of which there are more, are shuffled by their own key and by the index.
    named = in_databases(
        tables["index_usage"].drop(PARTITION).join(indexes, _INDEX).join(objects, _OBJECT), tables["databases"], database
    )
    partitions = (
        tables["index_operational"].drop(PARTITION).join(tables["index_physical"].drop(PARTITION), by_partition).join(pages, page_key)
    )
    return (
        partitions.join(named, _INDEX)
        .orderBy(
            *KEYS,
            F.desc("user_seeks"),
            F.desc("user_scans"),
            *_INDEX[len(KEYS) :],
            "partition_number",
            "used_pages",
        )
        .selectExpr(
            *KEYS,
            "database_name",
            "table_name",
            "index_name",
            "type_desc",
            "partition_number",
            "user_seeks",
            "last_user_seek",
            "user_scans",
            "last_user_scan",
            "user_lookups",
            "user_updates AS total_user_writes",
            f"{reads} AS total_user_reads",
            f"user_updates - ({reads}) AS write_read_difference",
            "allow_row_locks",
            "row_lock_count",
            "row_lock_wait_count",
            "row_lock_wait_in_ms",
            "allow_page_locks",
            "page_lock_count",
            "page_lock_wait_count",
            "page_lock_wait_in_ms",
            "fill_factor",
            "is_padded",
            "avg_fragmentation_in_percent",
            "avg_page_space_used_in_percent",
            "used_pages",
            "reserved_pages",
            "used_mb",
            "reserved_mb",
            "page_io_latch_wait_count",
            "page_io_latch_wait_in_ms",
        )
    )
