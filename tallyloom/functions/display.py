"""What a dashboard shows: legend text, threshold states and readable units."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .labels import label

# Unit scales, smallest first, as (lower bound, divisor, suffix).
_BINARY = [(0, 1, " B"), (2**10, 2**10, " KiB"), (2**20, 2**20, " MiB"),
           (2**30, 2**30, " GiB"), (2**40, 2**40, " TiB"), (2**50, 2**50, " PiB")]
_PER_SECOND = [(0, 1, " B/s"), (1e3, 1e3, " kB/s"), (1e6, 1e6, " MB/s"),
               (1e9, 1e9, " GB/s"), (1e12, 1e12, " TB/s")]
_COUNT = [(0, 1, ""), (1e3, 1e3, " K"), (1e6, 1e6, " Mil"), (1e9, 1e9, " Bil"), (1e12, 1e12, " Tri")]
_SECONDS = [(0, 1e-6, " µs"), (1e-3, 1e-3, " ms"), (1, 1, " s"), (60, 60, " min"),
            (3600, 3600, " hour"), (86400, 86400, " day")]
_MILLIS = [(0, 1, " ms"), (1e3, 1e3, " s"), (6e4, 6e4, " min"), (3.6e6, 3.6e6, " hour"),
           (8.64e7, 8.64e7, " day")]
_UNITS = {
    "bytes": _BINARY,
    "Bps": _PER_SECOND,
    "short": _COUNT,
    "none": [(0, 1, "")],
    "s": _SECONDS,
    "ms": _MILLIS,
    "percent": [(0, 1, "%")],
    "percentunit": [(0, 0.01, "%")],
    "ops": [(low, by, f"{suffix} ops/s") for low, by, suffix in _COUNT],
    "reqps": [(low, by, f"{suffix} req/s") for low, by, suffix in _COUNT],
    "pps": [(low, by, f"{suffix} p/s") for low, by, suffix in _COUNT],
    "cores": [(0, 1, " cores")],
}


def legend(template: str) -> Column:
    """``"{{a}} / {{b}}"`` filled from the label columns; a missing label is empty."""
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[label(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def threshold_state(value: str | Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """State of the highest step reached; the first step has no lower bound."""
    column = F.col(value) if isinstance(value, str) else value
    ordered = sorted(steps, key=lambda s: float("-inf") if s[0] is None else s[0], reverse=True)
    state = F.lit(None).cast("string")
    for bound, name in reversed(ordered):
        reached = column.isNotNull() if bound is None else column >= bound
        state = F.when(reached, name).otherwise(state)
    return state


def format_unit(value: str | Column, unit: str) -> Column:
    """Two decimals and the largest suffix that keeps the number at 1 or more."""
    column = F.col(value) if isinstance(value, str) else value
    text = F.lit(None).cast("string")
    for bound, divisor, suffix in _UNITS[unit]:
        scaled = F.round(column / F.lit(float(divisor)), 2).cast("decimal(38,2)").cast("string")
        reached = column.isNotNull() if bound == 0 else F.abs(column) >= bound
        text = F.when(reached, F.concat(scaled, F.lit(suffix))).otherwise(text)
    return text
