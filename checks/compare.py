"""Run registered queries in both engines and compare the rows.

    python -m checks.compare [directory] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import queries

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TEST_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> list[str]:
    """Empty when both engines give the same columns and rows."""
    df = queries()[name](spark, sf_dir)
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _rows(columns, result.fetchall())
    if ours == theirs:
        return []
    only_ours, only_theirs = set(ours) - set(theirs), set(theirs) - set(ours)
    return [
        f"{len(ours)} rows != {len(theirs)} rows",
        *(f"only spark: {r}" for r in sorted(only_ours)[:3]),
        *(f"only check: {r}" for r in sorted(only_theirs)[:3]),
    ]


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names or queries():
        start = time.time()
        found = differences(spark, con, sf_dir, name)
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {name} {time.time() - start:.2f}s", *found, sep="\n  " if found else " ")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]))
