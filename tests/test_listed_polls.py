"""Newest polls found through the list of written snapshots."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SMALL_DIR
from pyspark.sql import functions as F

from fleetgauge import report, report_over
from fleetgauge.sources.adapters import telemetry
from fleetgauge.sources.snapshots import write_table


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines(df) -> list[str]:
    return sorted(map(repr, df.collect()))


def store(root, *histories, jobs) -> str:
    for history in histories:
        write_table(history, root, "activity")
    write_table(jobs, root, "jobs")
    return root


def files_read(df) -> int:
    """Files of the session history that all scans of a finished query opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, total = plan.collectLeaves(), 0
    if plan.nodeName() == "AdaptiveSparkPlan":
        leaves = plan.executedPlan().collectLeaves()
    stack = [leaves.apply(i) for i in range(leaves.size())]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            below = node.plan().collectLeaves()
            stack += [below.apply(i) for i in range(below.size())]
        elif "FileScan" in node.toString() and "collection_time" in node.toString():
            total += node.metrics().apply("numFiles").value()
    return total


@pytest.fixture(scope="module")
def history(spark):
    return telemetry(spark, SMALL_DIR, ["activity", "jobs"])


def moved(df, days: int, server: str | None = None):
    """The same polls some days later, of the same captures."""
    out = df.withColumn("collection_time", F.expr(f"collection_time + INTERVAL {days} DAYS"))
    return out.withColumn("server_name", F.lit(server)) if server else out


def test_same_rows_as_without_the_list(spark, history, tmp_path):
    root = store(str(tmp_path), history["activity"], jobs=history["jobs"])
    found = report_over(spark, root, "activity_latest", listed=True)
    assert lines(found) == lines(report("activity_latest", history)) != []


def test_servers_that_stopped_on_other_days(spark, history, tmp_path):
    """Each server's own newest day counts, also one that others went on after."""
    early, late = moved(history["activity"], 0, "early"), moved(history["activity"], 400, "late")
    jobs = history["jobs"].withColumn("server_name", F.lit("late"))
    root = store(str(tmp_path), early, late, jobs=jobs)
    found = report_over(spark, root, "activity_latest", listed=True)
    assert lines(found) == lines(report_over(spark, root, "activity_latest"))
    assert {r["server_name"] for r in found.select("server_name").collect()} == {"early", "late"}
    only = report_over(spark, root, "activity_latest", listed=True, servers=["early"])
    assert lines(only) == lines(report_over(spark, root, "activity_latest", servers=["early"]))


def test_range_of_days(spark, history, tmp_path):
    root = store(str(tmp_path), history["activity"], jobs=history["jobs"])
    until = {"last_date": dt.date(2024, 1, 5)}
    found = report_over(spark, root, "activity_latest", listed=True, **until)
    assert lines(found) == lines(report_over(spark, root, "activity_latest", **until)) != []


def test_what_is_read_does_not_grow_with_the_history(spark, history, tmp_path):
    """Four times the days, the same number of files opened; without the list the search opens them all."""
    opened = {}
    week = history["activity"].where("collection_time < TIMESTAMP_NTZ'2024-01-08'")
    for times in (1, 4):
        root = str(tmp_path / str(times))
        whole = week
        for i in range(1, times):
            whole = whole.union(moved(week, 7 * i))
        store(root, whole, jobs=history["jobs"])
        for listed in (True, False):
            opened[times, listed] = files_read(report_over(spark, root, "activity_latest", listed=listed))
    assert 0 < opened[4, True] == opened[1, True]
    assert opened[4, False] > 3 * opened[1, False]


def test_plan_keeps_its_partition_filter_without_broadcasts(spark, history, tmp_path):
    root = store(str(tmp_path), history["activity"], jobs=history["jobs"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(report_over(spark, root, "activity_latest", listed=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "array_contains(Subquery" in plan.replace("ReusedSubquery", "Subquery")


def test_nothing_listed(spark, history, tmp_path):
    root = str(tmp_path)
    write_table(history["jobs"], root, "jobs")
    write_table(history["activity"].limit(0), root, "activity", mode="overwrite")
    assert report_over(spark, root, "activity_latest", listed=True).collect() == []
