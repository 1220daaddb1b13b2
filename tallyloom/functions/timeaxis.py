"""Durations, fixed-width time floors and whole-second positions on the time axis."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(duration: str | int) -> int:
    """``"30s"``, ``"5m"``, ``"5 minutes"``, ``"1 hour"`` or a plain number, in seconds."""
    if isinstance(duration, int):
        count = duration
    else:
        match = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", duration)
        if not match:
            raise ValueError(f"not a duration: {duration!r}")
        unit = (match.group(2) or "s").lower()
        if unit[0] not in _UNIT_SECONDS or unit.startswith("mo"):
            raise ValueError(f"not a duration unit: {duration!r}")
        count = int(match.group(1)) * _UNIT_SECONDS[unit[0]]
    if count <= 0:
        raise ValueError(f"a duration must be positive: {duration!r}")
    return count


def interval(duration: str | int) -> Column:
    return F.expr(f"interval {seconds(duration)} seconds")


def floor_time(ts: str | Column, duration: str | int) -> Column:
    """Start of the fixed-width bucket holding ``ts``; keeps the timestamp type."""
    return F.window(ts, f"{seconds(duration)} seconds")["start"]


def is_ntz(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.TimestampNTZType)


def _origin(ntz: bool) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") if ntz else F.timestamp_seconds(F.lit(0))


def to_position(ts: str | Column, ntz: bool) -> Column:
    """Seconds since 1970 of a whole-second timestamp, without any time zone step."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return (column - _origin(ntz)).cast(T.DayTimeIntervalType(3, 3)).cast("long")


def from_position(position: str | Column, ntz: bool) -> Column:
    column = F.col(position) if isinstance(position, str) else position
    return F.timestamp_add("SECOND", column, _origin(ntz))


def known(column: Column, ntz: bool) -> Column:
    """The timestamp declared non-null, for rows already filtered.

    Spark then adds no null checks to joins on it, and both sides of a join of a
    table with its own totals keep the same plan, so the shuffle is used twice.
    """
    return F.coalesce(column, _origin(ntz))


def calendar(ts: str | Column, unit: str, ntz: bool = True) -> Column:
    """``date_trunc`` that hands back the type it was given."""
    truncated = F.date_trunc(unit, ts)
    return truncated.cast("timestamp_ntz") if ntz else truncated
