"""Diagnostic reports over database-server telemetry, as lazy Spark DataFrames."""

from fleetgauge.plans import REPORTS, Report, report, report_over

__all__ = ["REPORTS", "Report", "report", "report_over"]
