"""A table's state as numbered files of JSON, of which the last one counts.

A writer adds the next number; if another one was faster its own fails and changes nothing.
What a version names exists before the version does.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from . import files


class Conflict(ValueError):
    """Another writer was faster."""


def name(number: int) -> str:
    return f"{number:020d}.json"


def numbers(names) -> list[int]:
    """The versions among the files of a folder."""
    return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())


def last(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(number, content) of the last version; (-1, None) if there is none."""
    found = numbers(files.file_names(spark, folder))
    if not found:
        return -1, None
    return found[-1], json.loads(files.read_text(spark, f"{folder}/{name(found[-1])}"))


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    try:
        files.publish_text(spark, f"{folder}/{name(number)}", json.dumps(content))
    except Exception as error:
        if number in numbers(files.file_names(spark, folder)):
            raise Conflict(f"another writer made version {number} of {folder}") from error
        raise
