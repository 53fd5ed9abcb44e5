"""One local session and a builder of small telemetry tables."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetgauge.session import builder  # noqa: E402
from fleetgauge.sources.schemas import KEYS, partition_time, schema  # noqa: E402

NOW = dt.datetime(2024, 2, 1)
SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        builder("tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """``table("jobs", {...}, {...})``: rows of a telemetry table, other columns NULL."""

    def make(name: str, *rows: dict):
        fields = schema(name).fields
        full = []
        for row in rows:
            unknown = set(row) - {f.name for f in fields}
            assert not unknown, unknown
            row = {"server_name": "srv", "collected_at": NOW, **row}
            if row.get(partition_time(name)) is not None:
                row.setdefault("collected_date", row[partition_time(name)].date())
            full.append(tuple(row.get(f.name) for f in fields))
        return spark.createDataFrame(full, schema(name))

    return make


def rows(df, *columns: str, keys: bool = False) -> list[tuple]:
    """Rows as tuples, in the report's order and without the fleet keys."""
    columns = columns or tuple(c for c in df.columns if keys or c not in KEYS)
    return [tuple(r[c] for c in columns) for r in df.collect()]
