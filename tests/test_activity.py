from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows

from fleetgauge.plans import activity

KEY = "0x33221100554477668899AABBCCDDEEFF"
UUID = "00112233-4455-6677-8899-aabbccddeeff"
NAMELESS = "10112233-4455-6677-8899-aabbccddeeff"
STEP = "SQLAgent - TSQL JobStep (Job {} : Step 1)"
START, END = "2021-01-15 06:00:00.753", "2021-01-15 11:00:00.753"


def at(text):
    return dt.datetime.fromisoformat(f"2021-01-15 {text}")


def poll(session, time, **more):
    return {"session_id": session, "collection_time": at(time), "start_time": at("05:00:00"), "blocking_session_count": 0,
            "writes": 0, "physical_reads": 0, "host_name": "h", "program_name": "app", **more}


@pytest.fixture
def tables(table):
    return {
        "activity": table(
            "activity",
            poll(1, "05:59:59", blocking_session_id=9),  # before the range
            poll(2, "06:00:00.753", program_name=STEP.format(KEY), writes=5, physical_reads=5, blocking_session_id=9),
            poll(3, "06:30:00", program_name=STEP.format(KEY.lower()), writes=20, blocking_session_id=9),
            poll(4, "07:00:00", program_name=STEP.format(KEY[:2] + "9" * 32), blocking_session_count=2),
            poll(5, "07:00:00", program_name=STEP.format("0x33221110554477668899AABBCCDDEEFF"), blocking_session_count=1),
            poll(6, "07:59:59.999", writes=None, blocking_session_id=0),
            poll(7, "11:00:00.753", program_name=None, physical_reads=7, start_time=at("04:00:00")),
            poll(8, "11:00:00.753", blocking_session_count=None, **{"dd hh:mm:ss.mss": "00 00:00:01.000"}),
            poll(9, "11:00:00.754", blocking_session_id=1),  # after the range
        ),
        "jobs": table("jobs", {"job_id": UUID, "name": "Backup"}, {"job_id": NAMELESS, "name": None}),
    }


def test_labels_and_io_order(tables):
    got = rows(activity.activity_io_offenders(tables, START, END), "writes", "physical_reads", "program_name")
    assert got == [
        (20, 0, "Job - Backup"),
        (5, 5, "Job - Backup"),
        (0, 7, None),
        (0, 0, STEP.format(KEY[:2] + "9" * 32)),  # no such job
        (0, 0, STEP.format("0x33221110554477668899AABBCCDDEEFF")),  # a job without a name
        (0, 0, "app"),
        (None, 0, "app"),  # unknown I/O last
    ]


def test_latest_poll(tables):
    got = activity.activity_latest(tables)
    assert rows(got, "session_id") == [(9,)]
    tables["activity"] = tables["activity"].where("session_id <> 9")
    got = rows(activity.activity_latest(tables), "session_id", "program_name", "duration")
    assert got == [(7, None, None), (8, "app", "00 00:00:01.000")]


def test_blocked_and_blocking(tables):
    got = rows(activity.activity_blocking(tables, START, END), "session_id")
    assert got == [(2,), (3,), (4,), (5,), (6,)]


def test_counts_per_hour(tables):
    got = rows(activity.blocked_per_hour(tables, START, END), "hour", "program", "blocked_count")
    assert got == [("2021-01-15 06", "Job - Backup", 2), ("2021-01-15 07", "app", 1)]
    got = rows(activity.blocking_per_hour(tables, START, END), "hour", "blocking_count")
    assert got == [("2021-01-15 07", 1), ("2021-01-15 07", 1)]


def test_sessions_per_program(tables):
    got = rows(activity.sessions_per_program(tables, START, END), "program", "host_name", "session_count")
    assert got == [
        (None, "h", 1),
        ("Job - Backup", "h", 2),
        (STEP.format("0x33221110554477668899AABBCCDDEEFF"), "h", 1),
        (STEP.format(KEY[:2] + "9" * 32), "h", 1),
        ("app", "h", 2),
    ]
    assert rows(activity.sessions_per_program(tables, at("06:30:00"), at("06:30:00")), "session_count") == [(1,)]


def test_counts_add_up(tables):
    blocked = tables["activity"].where("blocking_session_id IS NOT NULL").count()
    wide = ("2021-01-01", "2021-02-01")
    got = rows(activity.blocked_per_hour(tables, *wide), "blocked_count")
    assert sum(n for (n,) in got) == blocked
    got = rows(activity.sessions_per_program(tables, *wide), "session_count")
    assert sum(n for (n,) in got) == tables["activity"].count()


REPORTS_OF_HISTORY = ("activity_latest", "activity_io_offenders", "activity_blocking", "blocked_per_hour",
                      "blocking_per_hour", "sessions_per_program")


@pytest.fixture
def stored_later(spark, tables, tmp_path):
    """Polls of 14 and 15 January, captured on 1 February, in stored tables."""
    from pyspark.sql import functions as F

    from fleetgauge.sources.snapshots import write_table

    day = F.expr("INTERVAL '1' DAY")
    earlier = tables["activity"].withColumn("collection_time", F.col("collection_time") - day)
    # What the frame says about its day is not to be trusted.
    both = tables["activity"].unionByName(earlier).withColumn("collected_date", F.expr("DATE'2024-02-01'"))
    write_table(both, str(tmp_path), "activity")
    write_table(tables["jobs"], str(tmp_path), "jobs")
    return str(tmp_path), both


@pytest.mark.parametrize("name", REPORTS_OF_HISTORY)
def test_dates_keep_job_labels(spark, tables, stored_later, name):
    from test_registered import plan_text

    from fleetgauge import report, report_over

    root, _ = stored_later
    day = dt.date(2021, 1, 15)
    params = {} if name == "activity_latest" else {"start": START, "end": END}
    got = report_over(spark, root, name, first_date=day, last_date=day, **params)
    direct = report(name, tables, **params)
    assert rows(got, keys=True) == rows(direct, keys=True) != []
    assert "collected_date" in plan_text(got) and "PartitionFilters: [isnotnull(collected_date" in plan_text(got)
    if name in ("activity_io_offenders", "blocked_per_hour", "sessions_per_program"):
        column = "program_name" if "program_name" in got.columns else "program"
        assert ("Job - Backup",) in rows(got, column)


@pytest.mark.parametrize("name", REPORTS_OF_HISTORY)
def test_a_frame_with_another_day_is_read_right(tables, stored_later, name):
    from fleetgauge import report

    _, both = stored_later
    params = {} if name == "activity_latest" else {"start": START, "end": END}
    assert rows(report(name, {**tables, "activity": both}, **params)) == rows(report(name, tables, **params)) != []
