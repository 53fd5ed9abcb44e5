"""Tables stored by bucket: the same reports, without exchanges for their joins."""

from __future__ import annotations

import os
import re

import pytest
from conftest import SMALL_DIR
from pyspark.sql import functions as F

from fleetgauge import REPORTS, report, report_over
from fleetgauge.sources.adapters import telemetry
from fleetgauge.sources.buckets import LAYOUT, bucket_days, bucketed_session, read_bucketed, write_bucketed
from fleetgauge.sources.snapshots import write_table

BUCKETS = 8
USED = ["index_profile", "unused_indexes", "drive_latency", "io_profile_by_file", "io_stalls_by_file"]


def listed(df) -> list[str]:
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    """Two captures of every table the reports of indexes and files read."""
    names = sorted({t for name in USED for t in REPORTS[name].tables})
    again = F.expr("collected_at + INTERVAL '1' DAY")
    return {t: df.unionByName(df.withColumn("collected_at", again)) for t, df in telemetry(spark, SMALL_DIR, names).items()}


@pytest.fixture(scope="module")
def root(tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bucketed"))
    for name, df in tables.items():
        if name in LAYOUT:
            write_bucketed(df, folder, name, BUCKETS)
        else:
            write_table(df, folder, name)
    return folder


@pytest.mark.parametrize("name", USED)
def test_same_rows(spark, tables, root, name):
    assert listed(report_over(spark, root, name, buckets=BUCKETS)) == listed(report(name, tables))


@pytest.mark.parametrize("name", ["index_profile", "drive_latency", "io_profile_by_file", "unused_indexes"])
def test_joins_of_facts_need_no_exchange(spark, tables, root, name):
    """With broadcasting off but for the databases, whose number a server bounds."""
    session = bucketed_session(spark)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        session.conf.set(key, "-1")
    wanted = REPORTS[name].tables
    found = read_bucketed(session, root, [t for t in wanted if t in LAYOUT], buckets=BUCKETS)
    if "databases" in wanted:
        found["databases"] = F.broadcast(session.read.parquet(f"{root}/databases"))
    got = report(name, found)
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = plan.count("SortMergeJoin")
    assert joins == {"index_profile": 5, "drive_latency": 2, "io_profile_by_file": 1, "unused_indexes": 3}[name]
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\), ENSURE", plan)
    # What is left is the final grouping by names.
    assert len(keys) == {"index_profile": 0, "drive_latency": 1, "io_profile_by_file": 0, "unused_indexes": 1}[name], keys
    assert listed(got) == listed(report(name, tables))


def test_one_file_for_each_bucket_and_day(root):
    for _, _, files in os.walk(f"{root}/bucketed-{BUCKETS}/index_physical"):
        data = [f for f in files if f.endswith(".parquet")]
        assert len(data) <= BUCKETS and len({re.search(r"_(\d{5})\.", f)[1] for f in data}) == len(data)


def test_days_are_replaced_and_found_by_others(spark, tables, root, tmp_path):
    folder, io = str(tmp_path), tables["file_io"]
    days = [r[0] for r in io.selectExpr("CAST(collected_at AS DATE) AS d").distinct().orderBy("d").collect()]
    on = lambda day: io.where(F.expr("CAST(collected_at AS DATE)") == F.lit(day))
    other = spark.newSession()
    for day in (days[0], days[0], days[1]):
        write_bucketed(on(day), folder, "file_io", BUCKETS)
        seen = read_bucketed(other, folder, ["file_io"], buckets=BUCKETS)["file_io"]
    assert seen.count() == io.count()
    one = read_bucketed(other, folder, ["file_io"], first_date=days[1], servers=["srv1"], buckets=BUCKETS)["file_io"]
    assert one.count() == on(days[1]).where("server_name = 'srv1'").count()
    assert re.search(r"PartitionFilters: \[[^\]]*collected_date", one._jdf.queryExecution().executedPlan().toString())


def test_appended_days_are_stored_by_bucket(spark, tables, tmp_path):
    folder = str(tmp_path)
    for name in REPORTS["drive_latency"].tables:
        write_table(tables[name], folder, name)
    bucket_days(spark, folder, REPORTS["drive_latency"].tables, buckets=3)
    assert listed(report_over(spark, folder, "drive_latency", buckets=3)) == listed(report("drive_latency", tables))


def test_another_number_of_buckets_is_another_table(spark, root):
    with pytest.raises(Exception, match="does not exist"):
        read_bucketed(spark, root, ["file_io"], buckets=BUCKETS + 1)
