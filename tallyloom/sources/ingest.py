"""Text files into typed tables, malformed records set aside."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.records import ISO_TIME, json_error
from . import files

_CORRUPT = "_corrupt_record"


def _declared(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, with their file."""
    lines = spark.read.text(path).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"))
    return lines.filter(F.trim("record") != "")


def ingest_jsonl(
    spark: SparkSession, path: str, schema: str | StructType
) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (typed rows, bad lines with their file and the class of the error).

    Every line that is not blank is in exactly one of the two; see ``json_error`` for what
    is bad. Times are ISO 8601.
    """
    fields = _declared(schema)
    parsed, error = json_error("record", fields)
    marked = _lines(spark, path).withColumns({"_parsed": parsed, "error_class": error})
    good = marked.filter(F.col("error_class").isNull()).select(
        *[F.col(f"_parsed.{f}").alias(f) for f in fields.fieldNames()])
    return good, marked.filter(F.col("error_class").isNotNull()).select("record", "file", "error_class")


def _by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under a path by the names in their header. Of each file one line is read, many files at a time."""
    names = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(32) as pool:
        headers = pool.map(lambda name: files.first_line(spark, name), names)
        found: dict[tuple[str, ...], list[str]] = {}
        for name, header in zip(names, headers, strict=True):
            if header is not None:
                found.setdefault(tuple(next(csv.reader([header]))), []).append(name)
    return found


def _as_written(fields: StructType, header: tuple[str, ...], where: str) -> StructType:
    """The schema in the order of a header; what the schema does not name is text."""
    lacking = [f for f in fields.fieldNames() if header.count(f) != 1]
    if lacking:
        raise ValueError(f"{where} does not name {', '.join(lacking)} once in its header: {','.join(header)}")
    extra = (StructField(f"_unnamed_{i}", StringType()) for i in range(len(header)))
    return StructType([fields[n] if n in fields.fieldNames() else next(extra) for n in header])


def ingest_csv(
    spark: SparkSession, path: str, schema: str | StructType, multiline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """CSV with headers as (typed rows, bad records with their file).

    Each file's header, its first line, tells the order of its columns; those that the schema
    does not name are ignored, and a file that lacks one of the schema's is an error. A
    later line that equals the header is a record. All columns are parsed for both results,
    so a record is bad for one exactly if it is not good for the other.

    Without ``multiline`` a record is a line, and one that leaves a quote open is bad: half
    a value is never presented as a whole one. With it a quoted value may hold line ends;
    then Spark reads each file as a whole, in one task.
    """
    fields = _declared(schema)
    read = _read_records if multiline else _read_lines
    parts = [read(spark, names, fields, _as_written(fields, header, names[0]))
             for header, names in _by_header(spark, path).items()]
    if not parts:
        return spark.createDataFrame([], fields), spark.createDataFrame([], "record string, file string")
    good, bad = zip(*parts, strict=True)
    return reduce(DataFrame.unionAll, good), reduce(DataFrame.unionAll, bad)


_CSV = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "escape": '"',
        "timestampFormat": ISO_TIME, "timestampNTZFormat": ISO_TIME}
#: Reads a line as one column: nothing in it separates or quotes.
_WHOLE_LINE = {"sep": "\u0001\u0002\u0003\u0001", "quote": "", "escape": "\u0000", "maxCharsPerColumn": "-1"}


def _read_records(spark: SparkSession, names: list[str], fields: StructType, written: StructType) -> tuple[DataFrame, DataFrame]:
    """Records that may go over line ends, of files with one header."""
    raw = spark.read.schema(StructType(written.fields).add(_CORRUPT, StringType())).options(
        **_CSV, columnPruning=False, multiLine=True).csv(names, header=True)
    # always true, but it makes both results read every field: a record must not turn
    # good because a later select leaves its broken field out
    every = F.length(F.concat_ws("", *[F.col(f).cast("string") for f in written.fieldNames()])) >= 0
    raw = raw.filter(every)
    bad = raw.filter(F.col(_CORRUPT).isNotNull()).select(
        F.col(_CORRUPT).alias("record"), F.col("_metadata.file_path").alias("file"))
    return raw.filter(F.col(_CORRUPT).isNull()).select(*fields.fieldNames()), bad


def _read_lines(spark: SparkSession, names: list[str], fields: StructType, written: StructType) -> tuple[DataFrame, DataFrame]:
    """Records of a line each, of files with one header; Spark leaves out the first line of each file."""
    lines = spark.read.schema("record string").options(**_WHOLE_LINE).csv(names, header=True).select(
        "record", F.col("_metadata.file_path").alias("file"))
    quotes = F.length("record") - F.length(F.replace("record", F.lit('"')))
    parsed = F.from_csv("record", StructType(written.fields).add(_CORRUPT, StringType()).toDDL(), _CSV)
    marked = lines.filter(F.trim("record") != "").withColumn("_parsed", parsed)
    broken = (quotes % 2 == 1) | F.col(f"_parsed.{_CORRUPT}").isNotNull()
    good = marked.filter(~broken).select(*[F.col(f"_parsed.{f}").alias(f) for f in fields.fieldNames()])
    return good, marked.filter(broken).select("record", "file")
