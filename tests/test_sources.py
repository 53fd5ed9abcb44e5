from __future__ import annotations

import datetime as dt

import pytest
from conftest import NOW, SMALL_DIR

from fleetgauge.sources.adapters import telemetry
from fleetgauge.sources.schemas import KEYS, PARTITION, TABLES, schema
from fleetgauge.sources.snapshots import conform, read_table, read_tables, write_table


def test_every_table_carries_the_fleet_key(spark):
    assert len(TABLES) == 32
    for table in TABLES:
        assert [f.name for f in schema(table).fields][:3] == [*KEYS, PARTITION]


@pytest.mark.parametrize("name", TABLES)
def test_bindings_have_the_declared_schema(spark, name):
    df = telemetry(spark, SMALL_DIR, [name])[name]
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema(name)]


def test_unknown_table(spark):
    with pytest.raises(KeyError):
        telemetry(spark, SMALL_DIR, ["nothing"])


def test_round_trip_by_date_and_server(spark, tmp_path, table):
    root = str(tmp_path)
    days = [NOW - dt.timedelta(days=n) for n in range(3)]
    rows = [
        {"server_name": s, "collected_at": d, "database_id": i, "name": f"{s}{d.day}"}
        for i, (s, d) in enumerate((s, d) for s in ("a", "b") for d in days)
    ]
    df = table("databases", *rows)
    write_table(df.drop(PARTITION), root, "databases")
    whole = read_table(spark, root, "databases")
    assert [(f.name, f.dataType) for f in whole.schema] == [(f.name, f.dataType) for f in schema("databases")]
    assert sorted(whole.select("name").collect()) == sorted(df.select("name").collect())
    last = read_table(spark, root, "databases", first_date=days[1].date(), last_date=days[1].date(), servers=["b"])
    assert [r.name for r in last.collect()] == ["b31"]
    assert "PartitionFilters: [isnotnull(collected_date" in last._jdf.queryExecution().executedPlan().toString()
    write_table(df, root, "databases")  # again: nothing to add
    assert read_tables(spark, root, ["databases"])["databases"].count() == 6
    write_table(df.where(f"collected_date = DATE'{days[0].date()}' AND server_name = 'a'"), root, "databases", mode="overwrite")
    assert read_tables(spark, root, ["databases"])["databases"].count() == 5


def test_activity_is_partitioned_by_poll(spark, table):
    polled = dt.datetime(2021, 5, 6, 7, 8, 9)
    df = conform(table("activity", {"collection_time": polled}).drop(PARTITION), "activity")
    assert [r.collected_date for r in df.collect()] == [polled.date()]
