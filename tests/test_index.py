from __future__ import annotations

from decimal import Decimal as D
from itertools import product

import pytest
from conftest import NOW, rows

from fleetgauge.plans import index


def test_missing_index_texts(table):
    optional = list(product(["[e]", None], ["[i]", None], ["[x], [y]", None]))
    tables = {
        "mi_group_stats": table(
            "mi_group_stats",
            *({"group_handle": n, "user_seeks": 100 - n, "avg_total_user_cost": 2.0, "avg_user_impact": 50.0,
               "last_user_seek": NOW} for n in range(8)),
            {"group_handle": 99, "user_seeks": 10**9, "avg_total_user_cost": 1.0, "avg_user_impact": 1.0},
        ),
        "mi_groups": table("mi_groups", *({"index_group_handle": n, "index_handle": n + 10} for n in range(8))),
        "mi_details": table(
            "mi_details",
            *({"index_handle": n + 10, "statement": "[db].[dbo].[t.a]", "equality_columns": e,
               "inequality_columns": i, "included_columns": x} for n, (e, i, x) in enumerate(optional)),
        ),
    }
    got = rows(index.missing_indexes(tables), "index_advantage", "avg_cost", "included_columns", "create_index_statement")
    on = "CREATE INDEX [missing_index_{0}_1{0}_t.a] ON [db].[dbo].[t.a] ({1}){2}"
    columns = ["[e],[i]", "[e],[i]", "[e]", "[e]", "[i]", "[i]", "", ""]
    assert got == [
        (D(100 - n).quantize(D("0.01")), D("2.00"), "" if n % 2 else "[x], [y]",
         on.format(n, columns[n], "" if n % 2 else " INCLUDE ([x], [y])"))
        for n in range(8)
    ]
    assert len(rows(index.missing_indexes(tables, k=3))) == 3


def test_missing_index_name_is_cut(table):
    tables = {
        "mi_group_stats": table(
            "mi_group_stats", {"group_handle": 1, "user_seeks": 3, "avg_total_user_cost": 0.335, "avg_user_impact": 100.0}
        ),
        "mi_groups": table("mi_groups", {"index_group_handle": 1, "index_handle": 2}),
        "mi_details": table("mi_details", {"index_handle": 2, "statement": f"[d].[s].[{'n' * 40}]"}),
    }
    got = rows(index.missing_indexes(tables), "create_index_statement")[0][0]
    assert got == f"CREATE INDEX [missing_index_1_2_{'n' * 32}] ON [d].[s].[{'n' * 40}] ()"


@pytest.fixture
def catalog(table):
    def an_index(obj, number, name, db=1, kind=2, unique=False):
        return {"database_id": db, "object_id": obj, "index_id": number, "name": name, "type": kind, "is_unique": unique}

    def use(obj, number, db=1, seeks=0, scans=0, lookups=0, updates=3):
        return {"database_id": db, "object_id": obj, "index_id": number, "user_seeks": seeks, "user_scans": scans,
                "user_lookups": lookups, "user_updates": updates}

    def pages(obj, number, used, partition=1, db=1):
        return {"database_id": db, "object_id": obj, "index_id": number, "partition_number": partition,
                "used_page_count": used}

    names = ["IX_big", "IX_PK_", "PK", "pk_x", "PK_x", "PKx", None, "IX_seek", "IX_scan", "IX_lookup", "IX_new"]
    return {
        "databases": table(
            "databases",
            {"database_id": 1, "name": "one", "state_desc": "ONLINE"},
            {"database_id": 2, "name": "two", "state_desc": "OFFLINE"},
            {"database_id": 3, "name": "three", "state_desc": "ONLINE"},
        ),
        "indexes": table(
            "indexes",
            *(an_index(10, n, name) for n, name in enumerate(names, 2)),
            an_index(10, 50, "IX_unique", unique=True),
            an_index(10, 1, "IX_clustered", kind=1),
            an_index(20, 2, "IX_twin"),
            an_index(21, 2, "IX_twin"),
            an_index(10, 2, "IX_offline", db=2),
            an_index(10, 2, "IX_three", db=3),
        ),
        "objects": table(
            "objects",
            *({"database_id": d, "object_id": 10, "schema_name": "dbo", "name": "t"} for d in (1, 2, 3)),
            {"database_id": 1, "object_id": 20, "schema_name": "a", "name": "twin"},
            {"database_id": 1, "object_id": 21, "schema_name": "b", "name": "twin"},
        ),
        "index_usage": table(
            "index_usage",
            *(use(10, n, **{"IX_seek": {"seeks": 1}, "IX_scan": {"scans": 1}, "IX_lookup": {"lookups": 1}}.get(name, {}))
              for n, name in enumerate(names, 2) if name != "IX_new"),
            use(10, 50), use(10, 1), use(20, 2), use(21, 2), use(10, 2, db=2), use(10, 2, db=3),
        ),
        "partition_stats": table(
            "partition_stats", pages(10, 2, 200), pages(10, 2, 100, 2), pages(20, 2, 70), pages(21, 2, 70)
        ),
    }


def test_unused_indexes(catalog):
    got = rows(index.unused_indexes(catalog, ["one", "two"]), "database_name", "table_view", "index_name", "updates", "index_size_mb")
    assert got == [
        ("one", "t", "IX_big", 3, 2),  # both partitions: 300 pages, 2400 KB
        ("one", "twin", "IX_twin", 3, 1),  # two schemas in one line: 1120 KB
        ("one", "t", "IX_PK_", 3, 0),
        ("one", "t", "PK", 3, 0),
        ("one", "t", "pk_x", 3, 0),
    ]
    drop = rows(index.unused_indexes(catalog, ["three"]), "drop_index_statement")
    assert drop == [("DROP INDEX [IX_three] ON [three].[dbo].[t] WITH ( ONLINE = OFF )",)]
    assert len(rows(index.unused_indexes(catalog))) == 6


def test_never_touched_indexes_on_request(catalog):
    got = rows(index.unused_indexes(catalog, ["one"], include_never_touched=True), "index_name", "updates")
    assert ("IX_new", 0) in got and len(got) == 6


def test_index_profile(table):
    key = {"database_id": 1, "object_id": 10, "index_id": 2}

    def pages(partition, used):
        return {**key, "partition_number": partition, "in_row_used_page_count": used, "in_row_reserved_page_count": 1}

    tables = {
        "index_usage": table(
            "index_usage",
            {**key, "user_seeks": 5, "user_scans": 2, "user_lookups": 1, "user_updates": 3},
            {**key, "database_id": 2, "user_seeks": 1},
        ),
        "databases": table("databases", {"database_id": 1, "name": "one"}, {"database_id": 2, "name": "two"}),
        "objects": table("objects", *({"database_id": d, "object_id": 10, "name": "t"} for d in (1, 2))),
        "indexes": table("indexes", *({**key, "database_id": d, "name": f"IX{d}"} for d in (1, 2))),
        "index_operational": table("index_operational", *({**key, "partition_number": p} for p in (1, 2))),
        "index_physical": table(
            "index_physical", *({**key, "partition_number": p, "avg_fragmentation_in_percent": p * 1.0} for p in (1, 2))
        ),
        "partition_stats": table("partition_stats", pages(1, 64), pages(2, 192)),
    }
    columns = ("index_name", "partition_number", "total_user_reads", "write_read_difference", "used_mb")
    assert rows(index.index_profile(tables, "one", "t", match_partition=False), *columns) == [
        ("IX1", p, 8, -5, mb) for p in (1, 2) for mb in (0.5, 1.5)
    ]
    for unbound in ({}, {"database": "one"}, {"table": "t"}):
        with pytest.raises(ValueError):
            index.index_profile(tables, match_partition=False, **unbound)
    paired = rows(index.index_profile(tables, "one", "t"), *columns)
    assert paired == [("IX1", 1, 8, -5, 0.5), ("IX1", 2, 8, -5, 1.5)]
    assert rows(index.index_profile(tables, "one", "other")) == []
    assert dict(index.index_profile(tables).dtypes)["used_mb"] == "float"


def test_a_large_advantage_keeps_its_value(table):
    from decimal import Decimal as D

    tables = {
        "mi_group_stats": table("mi_group_stats", {"group_handle": 1, "user_seeks": 10**9, "avg_total_user_cost": 1e8,
                                                   "avg_user_impact": 100.0}),
        "mi_groups": table("mi_groups", {"index_group_handle": 1, "index_handle": 1}),
        "mi_details": table("mi_details", {"index_handle": 1, "statement": "[d].[s].[t]"}),
    }
    from fleetgauge.plans.index import missing_indexes

    assert rows(missing_indexes(tables), "index_advantage") == [(D(10**17) + D("0.00"),)]
