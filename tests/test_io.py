from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from conftest import NOW, rows

from fleetgauge.plans import io

GB = 2**30


def test_log_segments_keep_empty_databases(table):
    tables = {
        "log_segments": table("log_segments", *({"database_name": n} for n in ("a", "b", "b", "gone"))),
        "databases": table("databases", *({"database_id": i, "name": n} for i, n in enumerate("abc"))),
    }
    assert rows(io.log_segment_count(tables)) == [("b", 2), ("a", 1), ("c", 0)]


def file_io(file, reads=0, writes=0, read_ms=0, write_ms=0, read_bytes=0, write_bytes=0, db=1, **more):
    return {
        "database_id": db, "file_id": file, "num_of_reads": reads, "num_of_writes": writes,
        "num_of_bytes_read": read_bytes, "num_of_bytes_written": write_bytes, "io_stall_read_ms": read_ms,
        "io_stall_write_ms": write_ms, "io_stall": read_ms + write_ms, "size_on_disk_bytes": 2**20 + 2**19, **more,
    }


def test_drive_latency(table):
    tables = {
        "file_io": table(
            "file_io",
            file_io(1, reads=3, read_ms=10, read_bytes=100),
            file_io(2, reads=1, writes=2, read_ms=5, write_ms=9, read_bytes=1, write_bytes=31),
            file_io(3),
            file_io(4, reads=1),  # no volume
        ),
        "files": table(
            "files", *({"database_id": 1, "file_id": f, "physical_name": p + ":\\x"} for f, p in enumerate("cCdd", 1))
        ),
        "volumes": table(
            "volumes", *({"database_id": 1, "file_id": f, "volume_mount_point": m} for f, m in ((1, "M"), (2, "M"), (3, "N")))
        ),
    }
    assert rows(io.drive_latency(tables)) == [
        ("C:", "M", 3, 4, 4, 25, 15, 22),
        ("D:", "N", 0, 0, 0, 0, 0, 0),
    ]


def test_stalls_by_file(table):
    tables = {
        "file_io": table("file_io", file_io(1), file_io(2, reads=2, writes=1, read_ms=10, write_ms=1), file_io(2, db=2)),
        "files": table(
            "files",
            {"database_id": 1, "file_id": 1, "physical_name": "a", "size": 1},
            {"database_id": 1, "file_id": 2, "physical_name": "b", "size": 192},
        ),
        "databases": table("databases", {"database_id": 1, "name": "one"}),
    }
    columns = ("database_name", "physical_name", "avg_read_stall_ms", "avg_write_stall_ms", "avg_io_stall_ms",
               "file_size_mb", "io_stalls", "total_io")
    assert rows(io.io_stalls_by_file(tables), *columns) == [
        ("one", "b", D("3.3"), D("0.5"), D("2.8"), D("1.50"), 11, 3),
        ("one", "a", D("0.0"), D("0.0"), D("0.0"), D("0.01"), 0, 0),
    ]


def test_io_by_database(table):
    mb = 2**20
    tables = {
        "file_io": table(
            "file_io",
            file_io(1, read_bytes=3 * mb - 1),
            file_io(1, read_bytes=mb, write_bytes=mb - 1, db=2),
            file_io(2, write_bytes=2, db=2),
            file_io(1, db=3, read_bytes=mb - 1),
        ),
        "databases": table("databases", {"database_id": 1, "name": "one"}, {"database_id": 3, "name": "three"}),
    }
    expected = [
        (1, "one", D("2.00"), D("50.00")),
        (2, None, D("2.00"), D("50.00")),
        (3, "three", D("0.00"), D("0.00")),
    ]
    for strategy in ("plain", "bucketed"):
        assert rows(io.io_by_database(tables, strategy=strategy)) == expected
    tables["file_io"] = table("file_io", file_io(1))
    assert rows(io.io_by_database(tables), "io_percent") == [(None,)]


def test_io_warnings(table):
    def line(generation, minutes, text):
        return {"log_generation": generation, "log_date": NOW - dt.timedelta(minutes=minutes), "log_text": text}

    slow = "1 request Taking longer than 15 seconds"
    log = table("error_log", line(0, 3, slow), line(4, 1, slow), line(5, 2, slow), line(1, 0, "fine"))
    got = rows(io.io_warnings({"error_log": log}), "log_date")
    assert got == [(NOW - dt.timedelta(minutes=1),), (NOW - dt.timedelta(minutes=3),)]


def test_volume_space(table):
    def volume(file, mount, total, free):
        return {"database_id": 1, "file_id": file, "volume_mount_point": mount, "file_system_type": "X",
                "logical_volume_name": "v", "total_bytes": total, "available_bytes": free}

    tables = {
        "volumes": table(
            "volumes", volume(1, "M", 3 * GB, GB), volume(2, "M", 3 * GB, GB), volume(3, "N", 0, 0), volume(9, "O", GB, GB)
        ),
        "files": table("files", *({"database_id": 1, "file_id": f} for f in (1, 2, 3))),
    }
    assert rows(io.volume_space(tables)) == [
        ("M", "X", "v", D("3.00"), D("1.00"), D("33.33")),
        ("N", "X", "v", D("0.00"), D("0.00"), None),
    ]


def test_top_statements_by_avg_io(table):
    def stat(handle, reads, writes, executions, start=0, end=-1):
        return {"sql_handle": handle, "plan_handle": "p", "total_logical_reads": reads, "total_logical_writes": writes,
                "execution_count": executions, "statement_start_offset": start, "statement_end_offset": end}

    tables = {
        "query_stats": table(
            "query_stats", stat("a", 5, 4, 2), stat("a", 100, 0, 0, 2, 6), stat("b", 50, 0, 1), stat("c", 9, 0, 1)
        ),
        "sql_text": table(
            "sql_text",
            {"handle": "a", "dbid": 1, "objectid": 7, "text": "abcdef"},
            {"handle": "b", "dbid": 2, "objectid": 7, "text": "other"},
            {"handle": "c", "dbid": None, "text": "ad hoc"},
        ),
        "databases": table("databases", {"database_id": 1, "name": "one"}, {"database_id": 2, "name": "two"}),
        "objects": table("objects", {"database_id": 1, "object_id": 7, "schema_name": "dbo", "name": "proc"}),
    }
    assert rows(io.top_statements_by_avg_io(tables, "one")) == [
        ("one", "proc", 4, 2, "abcde"),
        ("one", "proc", None, 0, "ab"),
    ]
    got = rows(io.top_statements_by_avg_io(tables, k=1), "database_name", "avg_io")
    assert got == [("one", 4), ("two", 50)]


def test_profile_by_file(table):
    tables = {
        "file_io": table(
            "file_io",
            file_io(1, reads=1, writes=2, read_ms=1, write_ms=7, read_bytes=2**20, write_bytes=2**21),
            file_io(2),
            file_io(1, db=2, reads=5),  # same file number, other database
        ),
        "db_files": table(
            "db_files", *({"database_id": d, "file_id": f, "name": f"f{d}{f}"} for d, f in ((1, 1), (1, 2), (2, 1)))
        ),
        "databases": table("databases", {"database_id": 1, "name": "one"}, {"database_id": 2, "name": "two"}),
    }
    columns = ("logical_name", "size_on_disk_mb", "io_stall_reads_pct", "io_stall_writes_pct", "total_io", "mb_read",
               "mb_written", "reads_pct", "writes_pct", "read_bytes_pct", "written_bytes_pct")
    assert sorted(rows(io.io_profile_by_file(tables, "one"), *columns)) == [
        ("f11", D("1.50"), D("12.5"), D("87.5"), 3, D("1.00"), D("2.00"), D("33.3"), D("66.7"), D("33.3"), D("66.7")),
        ("f12", D("1.50"), None, None, 0, D("0.00"), D("0.00"), None, None, None, None),
    ]
    assert len(rows(io.io_profile_by_file(tables))) == 3


def test_large_counters_keep_their_value(table):
    """More than the narrow decimals of the scripts can hold."""
    counters = file_io(1, reads=1, read_bytes=2 * 10**14, read_ms=10**11)
    tables = {
        "file_io": table("file_io", counters),
        "files": table("files", {"database_id": 1, "file_id": 1, "physical_name": "a", "size": 10**15}),
        "db_files": table("db_files", {"database_id": 1, "file_id": 1, "name": "a", "physical_name": "a"}),
        "databases": table("databases", {"database_id": 1, "name": "one"}),
    }
    assert rows(io.io_profile_by_file(tables), "mb_read") == [(D("190734863.28"),)]
    assert rows(io.io_stalls_by_file(tables), "avg_read_stall_ms") == [(D("50000000000.0"),)]
    tables["file_io"] = table("file_io", file_io(1, read_bytes=2**62))
    assert rows(io.io_by_database(tables), "total_io_mb") == [(D(2**42) + D("0.00"),)]
