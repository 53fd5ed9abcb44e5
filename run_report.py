"""Run one report over stored snapshots, for spark-submit.

    spark-submit run_report.py ROOT REPORT [--first-date D] [--last-date D]
                 [--server S ...] [--param NAME=VALUE ...] [--out PATH]

Values are read as JSON where they are JSON (``k=10``, ``ignore=["A"]``) and as
text otherwise.  Without ``--out`` the first lines are printed.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from fleetgauge import REPORTS, report_over
from fleetgauge.session import builder


def parameter(text: str) -> tuple[str, object]:
    name, _, value = text.partition("=")
    try:
        return name, json.loads(value)
    except json.JSONDecodeError:
        return name, value


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run one report over stored snapshots.")
    parser.add_argument("root", help="folder with one Parquet folder per telemetry table")
    parser.add_argument("report", choices=sorted(REPORTS))
    parser.add_argument("--first-date", type=dt.date.fromisoformat)
    parser.add_argument("--last-date", type=dt.date.fromisoformat)
    parser.add_argument("--server", action="append", dest="servers")
    parser.add_argument("--param", action="append", type=parameter, default=[])
    parser.add_argument("--out", help="Parquet folder to write")
    args = parser.parse_args(argv)

    result = report_over(
        builder(args.report).getOrCreate(),
        args.root,
        args.report,
        first_date=args.first_date,
        last_date=args.last_date,
        servers=args.servers,
        **dict(args.param),
    )
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        result.show(50, truncate=False)


if __name__ == "__main__":
    main()
