"""Names compared without case and trailing blanks, on request."""

from __future__ import annotations

from conftest import NOW, rows

from fleetgauge import report
from fleetgauge.sources.snapshots import with_collation


def test_database_and_segment_names(table):
    tables = {
        "databases": table("databases", {"database_id": 1, "name": "Sales"}),
        "log_segments": table("log_segments", {"database_name": "SALES "}, {"database_name": "sales"}),
    }
    assert rows(report("log_segment_count", tables)) == [("Sales", 0)]
    assert rows(report("log_segment_count", with_collation(tables))) == [("Sales", 2)]


def test_database_parameter(table):
    tables = {
        "databases": table("databases", {"database_id": 1, "name": "Sales"}),
        "procedures": table("procedures", {"database_id": 1, "object_id": 1, "name": "p"}),
        "proc_stats": table(
            "proc_stats", {"database_id": 1, "object_id": 1, "cached_time": NOW, "execution_count": 1}
        ),
    }
    assert rows(report("top_procedures", tables, database="sales")) == []
    got = report("top_procedures", with_collation(tables), database="sales")
    assert rows(got, "database_name", "sp_name") == [("Sales", "p")]


def test_ignored_waits_and_index_prefix(table):
    waits = {
        "wait_stats": table(
            "wait_stats",
            *({"wait_type": w, "wait_time_ms": 5, "waiting_tasks_count": 1} for w in ("waitfor ", "A")),
        )
    }
    assert rows(report("wait_pareto", waits), "wait_type") == [("A",), ("waitfor ",)]
    for strategy in ("plain", "bucketed"):
        assert rows(report("wait_pareto", with_collation(waits), strategy=strategy), "wait_type") == [("A",)]

    key = {"database_id": 1, "object_id": 1}
    names = ["pk_a", "Pk", "PKx", "ix"]
    indexes = {
        "databases": table("databases", {"database_id": 1, "name": "d", "state_desc": "Online"}),
        "objects": table("objects", {**key, "name": "t"}),
        "indexes": table(
            "indexes",
            *({**key, "index_id": n, "name": name, "type": 2, "is_unique": False} for n, name in enumerate(names)),
        ),
        "index_usage": table(
            "index_usage",
            *({**key, "index_id": n, "user_seeks": 0, "user_scans": 0, "user_lookups": 0} for n in range(4)),
        ),
        "partition_stats": table("partition_stats"),
    }
    assert rows(report("unused_indexes", indexes)) == []
    got = rows(report("unused_indexes", with_collation(indexes), allowed_databases=["D"]), "index_name", "index_size_mb")
    assert sorted(got) == [("Pk", 0), ("ix", 0)]


def test_session_names(table):
    import datetime as dt

    def poll(session, **more):
        time = dt.datetime(2024, 1, 1)
        return {"session_id": session, "collection_time": time, "start_time": time, "host_name": "h",
                "blocking_session_id": 1, "blocking_session_count": 1, **more}

    job = "SQLAgent - TSQL JobStep (Job 0x33221100554477668899AABBCCDDEEFF : Step 1)"
    tables = {
        "activity": table(
            "activity",
            *(poll(i, program_name=n) for i, n in enumerate(["App", "app", "app ", job, job.lower()])),
        ),
        "jobs": table("jobs", {"job_id": "00112233-4455-6677-8899-aabbccddeeff", "name": "Backup"}),
    }
    span = {"start": "2024-01-01 00:00:00", "end": "2024-01-02 00:00:00"}
    for name, count in (("sessions_per_program", "session_count"), ("blocked_per_hour", "blocked_count"),
                        ("blocking_per_hour", "blocking_count")):
        got = rows(report(name, with_collation(tables), **span), "program", count)
        assert sorted((p.lower().strip(), n) for p, n in got) == [("app", 3), ("job - backup", 2)]
        assert len(rows(report(name, tables, **span))) > 2


def test_hot_groups_of_collated_names_are_cut(spark):
    """Names that differ in case alone are one name, also where a group is cut at some of its rows."""
    from fleetgauge.operators.ranking import ordered

    rows = spark.range(3000).selectExpr(
        "CAST(IF(id % 2 = 0, 'Hot', 'hot') AS STRING COLLATE UTF8_LCASE_RTRIM) AS g", "id % 100 AS m",
        "CAST(concat(IF(id % 3 = 0, 'E', 'e'), id) AS STRING COLLATE UTF8_LCASE_RTRIM) AS e",
    )
    cut, plain = (
        ordered(rows, ["m"], ["e"], "m", ["g"], s, range_rows=100).selectExpr("CAST(e AS STRING)", "row_rank", "prior_sum")
        for s in ("bucketed", "plain")
    )
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
