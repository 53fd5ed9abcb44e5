"""Time every registered query and print one JSON line.

    BENCH_SF_DIR   test tables       (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads     (default 8)
    BENCH_REPEAT   runs per query, the median counts (default 3)

Results are written to the ``noop`` sink: every row is produced and none kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import BINDINGS, queries  # noqa: E402
from fleetgauge.session import builder  # noqa: E402


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = sys.argv[1:]
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    # Those that store their tables first are timed when named.
    chosen = {n: q for n, q in queries().items() if n in (only or BINDINGS)}
    seconds = {}
    for name, query in chosen.items():
        runs = [timed(lambda: query(spark, sf_dir)) for _ in range(repeat + 1)]
        # The first run loads classes and compiles generated code.
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over all reports",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
