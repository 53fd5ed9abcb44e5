"""Appending snapshots again, and after a failure."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from conftest import SMALL_DIR
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks.queries import BINDINGS
from fleetgauge import REPORTS, report
from fleetgauge.sources.adapters import telemetry
from fleetgauge.sources.schemas import schema
from fleetgauge.sources.snapshots import conform, read_table, read_tables, write_table, written_parts

DAY = dt.datetime(2024, 2, 1)


def listed(df) -> list[str]:
    return sorted(map(repr, df.collect()))


def waits(table, *snapshots: tuple[str, int, int]):
    """``(server, day, rows)`` snapshots of wait counters."""
    rows = [
        {"server_name": s, "collected_at": DAY + dt.timedelta(days=d), "wait_type": f"W{i}", "wait_time_ms": 10 * i + d,
         "waiting_tasks_count": 1, "signal_wait_time_ms": 0}
        for s, d, n in snapshots for i in range(n)
    ]
    return table("wait_stats", *rows)


@pytest.mark.parametrize("name", ["wait_pareto", "blocked_per_hour", "io_by_database"])
def test_the_same_append_twice(spark, tmp_path, name):
    fn, params = BINDINGS[name]
    tables = telemetry(spark, SMALL_DIR, REPORTS[fn].tables)
    for _ in range(2):
        for t, df in tables.items():
            write_table(df, str(tmp_path), t)
    stored = read_tables(spark, str(tmp_path), REPORTS[fn].tables)
    assert listed(report(fn, stored, **params)) == listed(report(fn, tables, **params))


def test_only_what_is_missing_is_appended(spark, table, tmp_path):
    root = str(tmp_path)
    first, second = waits(table, ("a", 0, 3), ("a", 1, 2)), waits(table, ("a", 1, 2), ("b", 1, 4), ("b", 2, 1))
    write_table(first, root, "wait_stats")
    files = {f for _, _, names in os.walk(f"{root}/wait_stats") for f in names}
    write_table(second, root, "wait_stats")
    # Appended files only: nothing that was there is written anew.
    assert files <= {f for _, _, names in os.walk(f"{root}/wait_stats") for f in names}
    assert listed(read_table(spark, root, "wait_stats")) == listed(waits(table, ("a", 0, 3), ("a", 1, 2), ("b", 1, 4), ("b", 2, 1)))
    assert written_parts(spark, root, "wait_stats").count() == 4


def test_an_append_that_failed_half_way_is_repeated(spark, table, tmp_path):
    root, path = str(tmp_path), f"{tmp_path}/wait_stats"
    write_table(waits(table, ("a", 0, 3), ("a", 1, 2)), root, "wait_stats")
    batch = waits(table, ("b", 1, 5), ("b", 2, 5), ("c", 3, 2))
    # Some files of the batch were moved to their place, then the job died.
    left = conform(batch, "wait_stats").where("server_name = 'b' AND wait_type IN ('W0', 'W3')")
    left.write.mode("append").partitionBy("collected_date").parquet(path)
    for _ in range(2):
        write_table(batch, root, "wait_stats")
        expected = waits(table, ("a", 0, 3), ("a", 1, 2), ("b", 1, 5), ("b", 2, 5), ("c", 3, 2))
        assert listed(read_table(spark, root, "wait_stats")) == listed(expected)


def test_an_append_whose_source_fails(spark, table, tmp_path):
    root = str(tmp_path)
    batch = waits(table, ("a", 0, 5))
    broken = batch.withColumn("wait_time_ms", F.expr("IF(wait_type = 'W4', CAST(raise_error('lost') AS BIGINT), wait_time_ms)"))
    with pytest.raises(PySparkException):
        write_table(broken, root, "wait_stats")
    assert written_parts(spark, root, "wait_stats").count() == 0
    write_table(batch, root, "wait_stats")
    assert listed(read_table(spark, root, "wait_stats")) == listed(batch)


def test_rows_stored_before_there_was_a_list_are_replaced(spark, table, tmp_path):
    root, old = str(tmp_path), waits(table, ("a", 0, 3), ("b", 0, 1))
    conform(old, "wait_stats").write.partitionBy("collected_date").parquet(f"{root}/wait_stats")
    write_table(waits(table, ("a", 0, 4)), root, "wait_stats")
    assert listed(read_table(spark, root, "wait_stats")) == listed(waits(table, ("a", 0, 4), ("b", 0, 1)))


def test_only_days_of_the_batch_are_read(spark, table, tmp_path):
    root, path = str(tmp_path), tmp_path / "wait_stats"
    write_table(waits(table, ("a", 0, 3), ("a", 1, 2)), root, "wait_stats")
    for name in os.listdir(path / "collected_date=2024-02-01"):
        if name.endswith(".parquet"):
            (path / "collected_date=2024-02-01" / name).write_bytes(b"not a file any reader takes")
    for f in os.listdir(path / "collected_date=2024-02-01"):
        if f.endswith(".crc"):
            (path / "collected_date=2024-02-01" / f).unlink()
    batch = waits(table, ("b", 1, 2), ("b", 2, 2))
    conform(batch, "wait_stats").where("server_name = 'b' AND wait_type = 'W1'").write.mode("append").partitionBy(
        "collected_date"
    ).parquet(str(path))
    write_table(batch, root, "wait_stats")
    got = read_table(spark, root, "wait_stats", first_date=dt.date(2024, 2, 2))
    assert listed(got) == listed(waits(table, ("a", 1, 2), ("b", 1, 2), ("b", 2, 2)))


def test_snapshots_without_a_name_and_no_rows(spark, table, tmp_path):
    root = str(tmp_path)
    batch = waits(table, ("a", 0, 2)).withColumn("server_name", F.lit(None).cast("string"))
    for _ in range(2):
        write_table(batch, root, "wait_stats")
        write_table(batch.limit(0), root, "wait_stats")
    assert listed(read_table(spark, root, "wait_stats")) == listed(batch)


def test_replaced_days(spark, table, tmp_path):
    root = str(tmp_path)
    write_table(waits(table, ("a", 0, 3), ("b", 1, 2)), root, "wait_stats")
    write_table(waits(table, ("c", 1, 1)), root, "wait_stats", mode="overwrite")
    assert listed(read_table(spark, root, "wait_stats")) == listed(waits(table, ("a", 0, 3), ("c", 1, 1)))
    # The snapshot whose day was replaced can be appended again.
    write_table(waits(table, ("a", 0, 3), ("b", 1, 2), ("c", 1, 1)), root, "wait_stats")
    assert listed(read_table(spark, root, "wait_stats")) == listed(waits(table, ("a", 0, 3), ("b", 1, 2), ("c", 1, 1)))
    with pytest.raises(ValueError):
        write_table(waits(table, ("a", 0, 3)), root, "wait_stats", mode="ignore")
    assert read_table(spark, root, "wait_stats").schema.names == schema("wait_stats").names
