"""Stored hourly counts: the same reports, without the rows of whole days."""

from __future__ import annotations

import datetime as dt
import os
import re

import pytest
from conftest import SMALL_DIR
from pyspark.sql import functions as F

from fleetgauge import report, report_over
from fleetgauge.sources.adapters import telemetry
from fleetgauge.sources.rollups import read_hourly, roll_up
from fleetgauge.sources.snapshots import write_table

NAMES = ["blocked_per_hour", "blocking_per_hour", "sessions_per_program"]
RANGES = {
    "whole days": ("2024-01-03", "2024-01-06 23:59:59.999999"),
    "cut at both ends": ("2024-01-03 10:20:30", "2024-01-06 21:10:05"),
    "within a day": ("2024-01-04 08:00:00", "2024-01-04 16:00:00"),
    "two cut days": ("2024-01-04 08:00:00", "2024-01-05 16:00:00"),
    "one instant short": ("2024-01-03 00:00:00.000001", "2024-01-06 23:59:59.999998"),
    "everything": ("2020-01-01", "2030-01-01"),
    "turned": ("2024-01-06", "2024-01-03"),
}


def listed(df) -> list[str]:
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return telemetry(spark, SMALL_DIR, ["activity", "jobs"])


def store(tables, root: str) -> str:
    for name, df in tables.items():
        write_table(df, root, name)
    return root


@pytest.fixture(scope="module")
def root(spark, tables, tmp_path_factory):
    folder = store(tables, str(tmp_path_factory.mktemp("history")))
    roll_up(spark, folder)
    return folder


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("period", RANGES)
def test_same_rows(spark, tables, root, name, period):
    start, end = RANGES[period]
    got = report_over(spark, root, name, rollups=True, start=start, end=end)
    assert listed(got) == listed(report(name, tables, start=start, end=end))


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_whole_days_are_not_read(spark, tables, tmp_path, name):
    """Their files keep their footers, which are all that is looked at, but lose their pages."""
    folder = store(tables, str(tmp_path))
    roll_up(spark, folder)
    start, end = RANGES["cut at both ends"]
    expected = listed(report(name, tables, start=start, end=end))
    for day in ("2024-01-04", "2024-01-05"):
        place = tmp_path / "activity" / f"collected_date={day}"
        for f in os.listdir(place):
            path = place / f
            if f.endswith(".crc"):
                path.unlink()
            else:
                data = path.read_bytes()
                footer = 8 + int.from_bytes(data[-8:-4], "little")
                path.write_bytes(b"PAR1" + b"\xff" * (len(data) - footer - 4) + data[-footer:])
    assert listed(report_over(spark, folder, name, rollups=True, start=start, end=end)) == expected


@pytest.mark.parametrize("name", NAMES)
def test_late_and_uncounted_days_come_from_their_rows(spark, tables, tmp_path, name):
    folder = str(tmp_path)
    early = tables["activity"].where("session_id % 3 <> 0")
    store({"activity": early, "jobs": tables["jobs"]}, folder)
    roll_up(spark, folder, last_date=dt.date(2024, 1, 5))
    # Another capture of the same days.
    late = tables["activity"].where("session_id % 3 = 0 AND collection_time >= '2024-01-05'")
    late = late.withColumn("server_name", F.concat("server_name", F.lit("-late")))
    write_table(late, folder, "activity")
    both = {"activity": early.unionByName(late), "jobs": tables["jobs"]}
    for start, end in (RANGES["everything"], RANGES["cut at both ends"]):
        assert listed(report_over(spark, folder, name, rollups=True, start=start, end=end)) == listed(report(name, both, start=start, end=end))
    roll_up(spark, folder, first_date=dt.date(2024, 1, 5))
    start, end = RANGES["everything"]
    got = report_over(spark, folder, name, rollups=True, start=start, end=end)
    assert listed(got) == listed(report(name, both, start=start, end=end))


def test_jobs_are_named_when_read(spark, tables, root):
    renamed = tables["jobs"].selectExpr("* EXCEPT (name)", "concat('new ', name) AS name").select(tables["jobs"].columns)
    start, end = RANGES["whole days"]
    history = {"activity": tables["activity"], "jobs": renamed}
    expected = listed(report("sessions_per_program", history, start=start, end=end))
    stored = {**history, "activity_hourly": read_hourly(spark, root)}
    assert listed(report("sessions_per_program", stored, start=start, end=end)) == expected
    assert any("new " in line for line in expected)


def test_filters_hold_for_counts_as_well(spark, tables, root):
    start, end = RANGES["everything"]
    day = dt.date(2024, 1, 4)
    got = report_over(spark, root, "blocked_per_hour", first_date=day, last_date=day, servers=["srv1"], rollups=True, start=start, end=end)
    some = tables["activity"].where("server_name = 'srv1' AND CAST(collection_time AS DATE) = DATE'2024-01-04'")
    assert listed(got) == listed(report("blocked_per_hour", {**tables, "activity": some}, start=start, end=end)) != []


def test_days_are_pruned(spark, root):
    got = report_over(spark, root, "sessions_per_program", rollups=True, start="2024-01-03", end="2024-01-06 23:59:59.999999")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search("dynamicpruning", plan)
