"""Truncating and exactly rounded arithmetic on counters.

Telemetry counters are integers and the reports quote them as truncated
integers or as decimals rounded once, half up.  Spark's ``/`` on integers
gives a double, so every ratio goes through one of the helpers here.  A zero
or NULL denominator gives NULL instead of failing the job (ANSI mode raises
otherwise): one broken row must not take a fleet-wide report down.
"""

from __future__ import annotations


def int_div(num: str, den: str | int) -> str:
    """Integer quotient truncated toward zero; NULL where ``den`` is 0 or NULL."""
    return f"(({num}) div nullif({den}, 0))"


def int_div_or_zero(num: str, den: str) -> str:
    """Integer quotient, 0 where the denominator is exactly 0 (NULL stays NULL)."""
    return f"CASE WHEN ({den}) = 0 THEN 0L ELSE {int_div(num, den)} END"


def int_avg(value: str) -> str:
    """Aggregate: average of an integer column, truncated, NULLs left out."""
    return int_div(f"sum({value})", f"count({value})")


def decimal(value: str, scale: int) -> str:
    """``value`` as a decimal of that scale, wide enough for any counter."""
    return f"CAST({value} AS DECIMAL(38,{scale}))"


def half_up_ratio(num: str, den: str | int, scale: int) -> str:
    """``num / den`` as DECIMAL(38, scale), rounded half up.

    The quotient carries 16 or more fraction digits, so for denominators under
    10 ** (16 - scale) the one rounding that shows is the last.  The scripts
    this comes from quote narrower types, which a busy server's counters
    overflow; the value is kept here.
    """
    return decimal(f"CAST({num} AS DECIMAL(22,0)) / nullif(CAST({den} AS DECIMAL(20,0)), 0)", scale)


def percent_of(part: str, whole: str, scale: int) -> str:
    """``100 * part / whole`` rounded half up; NULL where ``whole`` is 0."""
    return half_up_ratio(f"CAST({part} AS DECIMAL(20,0)) * 100", whole, scale)
