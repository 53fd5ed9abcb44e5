"""Session settings the reports are meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan on measured sizes: small sides are broadcast, hot keys split,
    # small partitions merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def builder(app: str = "fleetgauge") -> SparkSession.Builder:
    """Session builder with the settings above; add master and sizes to it."""
    out = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out
