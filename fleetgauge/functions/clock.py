"""Calendar arithmetic that counts boundaries crossed, not time elapsed.

All helpers work on calendar fields, so a TIMESTAMP_NTZ column gives the same
answer under every session time zone.
"""

from __future__ import annotations

_FINER = {"day": 1, "hour": 24, "minute": 60, "second": 60}


def boundary_diff(unit: str, start: str, end: str) -> str:
    """Number of ``unit`` boundaries (day, hour, minute, second) between two times."""
    count = f"CAST(datediff(CAST({end} AS DATE), CAST({start} AS DATE)) AS BIGINT)"
    for name, size in _FINER.items():
        if name != "day":
            count = f"({count} * {size} + {name}({end}) - {name}({start}))"
        if name == unit:
            return count
    raise ValueError(f"unknown unit: {unit}")


def duration_text(start: str, end: str) -> str:
    """``<days>d hh:mm:ss`` where every part counts its own boundaries.

    The parts are not carried over from one another: 1.2 seconds across
    midnight read ``1d 01:01:02``.
    """

    def two_digits(unit: str, size: int) -> str:
        # right() keeps the low digits of a wider value, lpad the high ones.
        return f"right(concat('00', CAST({boundary_diff(unit, start, end)} % {size} AS STRING)), 2)"

    return (
        f"concat(CAST({boundary_diff('day', start, end)} AS STRING), 'd ', {two_digits('hour', 24)}, ':',"
        f" {two_digits('minute', 60)}, ':', {two_digits('second', 60)})"
    )


def hour_bucket(ts: str) -> str:
    """``yyyy-MM-dd HH`` label of a timestamp."""
    return f"substring(CAST({ts} AS STRING), 1, 13)"


def minus_millis(ts: str, millis: str) -> str:
    """``ts`` moved back by a number of milliseconds."""
    return f"timestampadd(MILLISECOND, -({millis}), {ts})"
