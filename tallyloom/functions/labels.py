"""Label matchers. A label is a string; a missing label counts as the empty string."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Matcher = tuple[str, str, str]

_QUANTIFIERS = "*?{+"
_PLAIN = re.compile(r"[A-Za-z0-9_/: -]*")


def label(name: str | Column) -> Column:
    """The label as a string that is never null."""
    column = F.col(name) if isinstance(name, str) else name
    return F.coalesce(column.cast("string"), F.lit(""))


def _alternatives(pattern: str) -> list[str]:
    """The pattern split at its outermost bars."""
    parts, depth = [""], 0
    for char in pattern:
        depth += (char == "(") - (char == ")")
        if char == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return parts


def _balanced(pattern: str) -> bool:
    """Every bracket that closes was opened in the pattern itself."""
    depth = 0
    for char in pattern:
        depth += (char == "(") - (char == ")")
        if depth < 0:
            return False
    return depth == 0


def _literal_prefixes(pattern: str) -> list[str]:
    """Literal beginnings of the alternatives, or [] if one of them has none.

    Parquet cannot skip on a regex but it can on a prefix, so the prefixes are
    added as a second, implied predicate.
    """
    if "\\" in pattern or "[" in pattern or not _balanced(pattern):
        return []
    prefixes = []
    for alternative in _alternatives(pattern):
        literal = _PLAIN.match(alternative).group()
        rest = alternative[len(literal):]
        if rest and rest[0] in _QUANTIFIERS:
            literal = literal[:-1]
        if not literal:
            return []
        prefixes.append(literal)
    return prefixes


def matches(name: str, op: str, value: str) -> Column:
    """One matcher: ``=``, ``!=``, ``=~`` or ``!~``. A regex covers the whole value."""
    column = F.col(name)
    if op == "=":
        return column == value if value else label(name) == ""
    if op == "!=":
        # a null never differs from '', so the plain comparison is enough and is pushed down
        return column != "" if not value else label(name) != value
    if op in ("=~", "!~"):
        whole = rf"\A(?:{value})\z"
        if op == "!~":
            return ~label(name).rlike(whole)
        prefixes = _literal_prefixes(value)
        hit = label(name).rlike(whole)
        if not prefixes:
            return hit
        return reduce(Column.__or__, [column.startswith(p) for p in prefixes]) & hit
    raise ValueError(f"unknown matcher operator {op!r}")


def all_match(matchers: Sequence[Matcher]) -> Column:
    return reduce(Column.__and__, [matches(*m) for m in matchers], F.lit(True))


def select_series(samples: DataFrame, matchers: Sequence[Matcher]) -> DataFrame:
    """Samples whose labels satisfy every matcher."""
    return samples.filter(all_match(matchers)) if matchers else samples


def promote_labels(samples: DataFrame, names: Sequence[str], labels: str = "labels") -> DataFrame:
    """Label map entries as flat columns, ready for grouping and joining."""
    kept = [c for c in samples.columns if c != labels and c not in names]
    return samples.select(*kept, *[label(F.col(labels)[n]).alias(n) for n in names])
