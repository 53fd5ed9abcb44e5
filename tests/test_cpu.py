from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import NOW, rows

from fleetgauge.plans import cpu

LATER = NOW + dt.timedelta(days=1)


def test_log_search(table):
    log = table(
        "error_log",
        {"log_generation": 0, "log_date": NOW, "log_text": "DETECTED 1 socket"},
        {"log_generation": 0, "log_date": NOW, "log_text": "detected nothing"},
        {"log_generation": 1, "log_date": NOW, "log_text": "detected 2 sockets"},
    )
    assert rows(cpu.log_search({"error_log": log}), "log_text") == [("DETECTED 1 socket",)]
    assert len(rows(cpu.log_search({"error_log": log}, generations=[0, 1]))) == 2


def test_schedulers(table):
    def scheduler(node, status, load):
        return {"parent_node_id": node, "status": status, "current_tasks_count": 3, "runnable_tasks_count": 2,
                "active_workers_count": 1, "load_factor": load}

    on, off = "VISIBLE ONLINE", "VISIBLE OFFLINE"
    schedulers = table("schedulers", scheduler(0, on, 1), scheduler(0, on, 2), scheduler(1, on, 2), scheduler(1, off, None))
    tables = {"schedulers": schedulers}
    assert rows(cpu.scheduler_count_by_node(tables)) == [(0, 2), (1, 1)]
    assert rows(cpu.scheduler_load(tables)) == [(off, 1, 3, 2, 1, None), (on, 3, 9, 6, 3, 1)]


def record(number, idle=None, process=None):
    nodes = "".join(
        f"<{tag}>{value}</{tag}>"
        for tag, value in (("ProcessUtilization", process), ("SystemIdle", idle))
        if value is not None
    )
    return (
        f'<Record id="{number}" type="X" time="1"><SchedulerMonitorEvent><SystemHealth>{nodes}'
        "</SystemHealth></SchedulerMonitorEvent></Record>"
    )


def test_cpu_history(table):
    monitor = "RING_BUFFER_SCHEDULER_MONITOR"

    def ring(ticks, text, kind=monitor):
        return {"ring_buffer_type": kind, "timestamp": ticks, "record": text}

    tables = {
        "ring_buffer": table(
            "ring_buffer",
            ring(1000, record(1, 70, 20)),
            ring(2000, record(2, None, 20)),
            ring(3000, '<Record id="3"><SystemHealth> broken'),
            ring(4000, '<Record id="4"><SchedulerMonitorEvent/></Record>'),
            ring(5000, record(5, 1, 1), "RING_BUFFER_OTHER"),
            ring(6000, record(6, 50, 50)),
        ),
        # 10007 / 3 ticks per ms, truncated to 3, so now is 10007 // 3 = 3335.
        "sys_info": table("sys_info", {"cpu_ticks": 10007, "ms_ticks": 2600}),
    }

    def at(ms):
        return NOW + dt.timedelta(milliseconds=ms)

    assert rows(cpu.cpu_history(tables)) == [
        (50, 50, 0, at(6000 - 3335)),
        (20, None, None, at(2000 - 3335)),
        (20, 70, 10, at(1000 - 3335)),
        (None, None, None, at(3000 - 3335)),
    ]
    assert rows(cpu.cpu_history(tables, k=1), "process_cpu") == [(50,)]
    tables["sys_info"] = table("sys_info", {"cpu_ticks": 5, "ms_ticks": 0})
    assert {r[0] for r in rows(cpu.cpu_history(tables), "event_time")} == {None}


def test_cpu_by_database(table):
    def plan(handle, *worker):
        return [{"plan_handle": handle, "sql_handle": f"s{i}", "total_worker_time": w} for i, w in enumerate(worker)]

    def attribute(handle, value, name="dbid"):
        return {"plan_handle": handle, "attribute": name, "value": value}

    tables = {
        "query_stats": table(
            "query_stats", *plan("p1", 999, 1000, 1999), *plan("p2", 5000), *plan("p3", 10**9), *plan("p4", 3000), *plan("p5", 1000)
        ),
        "plan_attributes": table(
            "plan_attributes", attribute("p1", "1"), attribute("p1", "9", "other"), attribute("p2", "2"),
            attribute("p3", "32767"), attribute("p4", "3"), attribute("p5", "bad"),
        ),
        "databases": table("databases", {"database_id": 1, "name": "one"}, {"database_id": 2, "name": "two"}),
    }
    # 0 + 1 + 1: truncated per statement, then summed.
    # The plan with an unreadable id counts, so the shares add up to all time but the resource database's.
    expected = [
        (1, "two", 5, D("45.45")), (2, None, 3, D("27.27")), (3, "one", 2, D("18.18")), (4, None, 1, D("9.09")),
    ]
    for strategy in ("plain", "bucketed"):
        assert rows(cpu.cpu_by_database(tables, strategy=strategy)) == expected


@pytest.fixture
def statements(table):
    def stat(handle, worker, executions, reads=0, **more):
        counters = ("worker_time", "elapsed_time", "logical_reads")
        return {
            "sql_handle": f"s{handle}", "plan_handle": f"p{handle}", "statement_start_offset": 0,
            "statement_end_offset": -1, "execution_count": executions, "total_physical_reads": 1,
            "total_logical_writes": reads, "max_logical_writes": 2, "creation_time": NOW, "last_execution_time": NOW,
            **{f"{agg}_{c}": worker for agg in ("total", "min", "max") for c in counters}, **more,
        }

    return {
        "query_stats": table(
            "query_stats", stat(1, 100, 3), stat(2, 90, 1), stat(3, 100, 0), stat(4, 10**6, 1), stat(5, 7, 2)
        ),
        "sql_text": table(
            "sql_text",
            *({"handle": f"{k}{i}", "dbid": d, "objectid": o, "text": f"text {i} "}
              for k in "sp" for i, d, o in ((1, 1, 10), (2, 2, 10), (3, None, None), (5, 1, 11))),
        ),
        "databases": table("databases", {"database_id": 1, "name": "one"}, {"database_id": 2, "name": "two"}),
        "objects": table(
            "objects",
            {"database_id": 1, "object_id": 10, "schema_name": "dbo", "name": "proc"},
            {"database_id": 1, "object_id": 11, "schema_name": None, "name": "odd"},
        ),
    }


def test_top_queries_by_worker_time(statements):
    got = cpu.top_queries_by_worker_time(statements, k=3)
    # Statement 4 has no text any more; 1 and 3 tie and go by plan handle.
    assert rows(got, "database_name", "query_text", "total_worker_time", "avg_worker_time", "execution_count") == [
        ("one", "text 1 ", 100, 33, 3),
        (None, "text 3 ", 100, None, 0),
        ("two", "text 2 ", 90, 90, 1),
    ]


def test_top_queries_by_cpu(statements):
    columns = ("object_name", "database_name", "total_cpu_time", "average_cpu_time")
    assert rows(cpu.top_queries_by_total_cpu(statements, k=4), *columns) == [
        ("dbo.proc", "one", 100, 33),
        (None, None, 100, None),
        (None, "two", 90, 90),  # object known in another database only
        (None, "one", 7, 3),  # no schema: no name
    ]
    assert rows(cpu.top_queries_by_avg_cpu(statements, k=2), *columns) == [
        (None, "two", 90, 90),
        ("dbo.proc", "one", 100, 33),
    ]


@pytest.fixture
def procedures(table):
    def stat(db, obj, cached, executions, total, **more):
        return {
            "database_id": db, "object_id": obj, "cached_time": cached, "execution_count": executions,
            "total_worker_time": total, "total_elapsed_time": total, "total_logical_reads": total,
            "total_logical_writes": total, "total_physical_reads": total, **more,
        }

    hour_ago = NOW - dt.timedelta(hours=1)
    return {
        "proc_stats": table(
            "proc_stats",
            stat(1, 1, hour_ago, 125, 50),
            stat(1, 2, NOW, 9, 40),  # cached this very minute
            stat(1, 3, None, 9, 30),
            stat(1, 4, hour_ago, 0, 0),
            stat(2, 1, hour_ago, 60, 99, total_physical_reads=5, total_logical_reads=1),
            stat(2, 2, hour_ago, 60, 98, total_physical_reads=5, total_logical_reads=2),
            stat(1, 9, hour_ago, 1, 1000),  # not a procedure
            stat(3, 1, hour_ago, 1, 1000),  # unknown database
        ),
        "procedures": table(
            "procedures",
            *({"database_id": d, "object_id": o, "name": f"p{d}{o}"}
              for d, o in ((1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1))),
        ),
        "databases": table("databases", {"database_id": 1, "name": "one"}, {"database_id": 2, "name": "two"}),
    }


def test_top_procedures_by_worker_time(procedures):
    got = cpu.top_procedures(procedures, "worker_time", "one")
    assert rows(got, "sp_name", "total_worker_time", "avg_worker_time", "calls_per_minute") == [
        ("p11", 50, 0, 2),
        ("p12", 40, 4, None),
        ("p13", 30, 3, None),
        ("p14", 0, None, 0),
    ]
    every = cpu.top_procedures(procedures, "worker_time", k=1)
    assert rows(every, "database_name", "sp_name") == [("one", "p11"), ("two", "p21")]


def test_top_procedures_by_reads_and_writes(procedures):
    got = cpu.top_procedures(procedures, "logical_reads", "one")
    # Unlike worker time, less than a minute counts as 0 calls.
    assert rows(got, "sp_name", "calls_per_minute") == [("p11", 2), ("p12", 0), ("p13", 0), ("p14", 0)]
    got = cpu.top_procedures(procedures, "logical_writes", "one")
    assert rows(got, "sp_name", "total_logical_writes") == [("p11", 50), ("p12", 40), ("p13", 30)]
    got = cpu.top_procedures(procedures, "physical_reads", "two")
    assert rows(got, "sp_name", "total_physical_reads", "total_logical_reads") == [("p22", 5, 2), ("p21", 5, 1)]
    assert "calls_per_minute" not in got.columns
    with pytest.raises(KeyError):
        cpu.top_procedures(procedures, "colour")


def test_active_requests(table):
    def request(session, text="s1", plan=None, start=NOW - dt.timedelta(seconds=90), **more):
        return {"session_id": session, "sql_handle": text, "plan_handle": plan, "start_time": start,
                "database_id": 1, "statement_start_offset": 0, "statement_end_offset": -1, **more}

    tables = {
        "requests": table(
            "requests",
            request(1, plan="p1", statement_start_offset=4, statement_end_offset=8),
            request(2, start=NOW - dt.timedelta(days=2, seconds=1)),
            request(3),  # no session
            request(4, text="gone"),
            request(5),  # the collector
        ),
        "sessions": table("sessions", *({"session_id": s, "host_name": f"h{s}"} for s in (1, 2, 4, 5))),
        "sql_text": table("sql_text", {"handle": "s1", "text": "abcdef  "}),
        "query_plan": table("query_plan", {"plan_handle": "p1", "query_plan": "<p/>"}),
        "databases": table("databases", {"database_id": 1, "name": "one"}),
    }
    got = cpu.active_requests(tables, exclude_sessions=[5])
    assert rows(got, "session_id", "host_name", "database_name", "duration", "sql_statement", "query_plan") == [
        (2, "h2", "one", "3d 01:01:01", "<?query --\rabcdef  \r--?>", None),
        (1, "h1", "one", "1d 01:02:30", "<?query --\rcde\r--?>", "<p/>"),
    ]


def test_head_blockers(table):
    def process(spid, blocked, **more):
        return {"spid": spid, "blocked": blocked, "dbid": 1, "loginame": "a-very-long-login", "hostname": "h", **more}

    tables = {
        # 1 blocks 2 and 5, 2 blocks 3; 4 is idle; 6 blocks 7 on two threads.
        "processes": table(
            "processes", process(1, 0), process(2, 1), process(3, 2), process(4, 0), process(5, 1),
            process(6, 0, cmd="a"), process(6, 0, cmd="b"), process(7, 6),
        ),
        "requests": table(
            "requests",
            {"session_id": 1, "sql_handle": "s1", "statement_start_offset": 4, "statement_end_offset": -1},
        ),
        "sql_text": table("sql_text", {"handle": "s1", "text": "abcdef "}),
        "databases": table("databases", {"database_id": 1, "name": "a database with a name"}),
    }
    got = rows(cpu.head_blockers(tables), "spid", "cmd", "loginame", "blk", "dbname", "sql_statement")
    assert sorted(got, key=str) == [
        (1, None, "a-very-long-", "0  ", "a database", "bcde"),
        (6, "a", "a-very-long-", "0  ", "a database", None),
        (6, "b", "a-very-long-", "0  ", "a database", None),
    ]
    tables["processes"] = table("processes", process(1, 0), process(2, 0))
    assert rows(cpu.head_blockers(tables)) == []
    # A session numbered 0 "blocks" every unblocked one.
    tables["processes"] = table("processes", process(0, 0), process(2, 0))
    assert rows(cpu.head_blockers(tables), "spid") == [(0,)]
