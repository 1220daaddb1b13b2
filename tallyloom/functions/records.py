"""Payload typing, metric renaming and stable ids."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

#: ISO 8601 times, with or without parts of a second.
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def typed_props(
    df: DataFrame,
    schema: str | StructType,
    payload: str = "props",
    defaults: Mapping[str, object] | None = None,
    keep_payload: bool = False,
) -> DataFrame:
    """JSON text column as typed columns; unknown fields are ignored, missing ones defaulted."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    defaults = defaults or {}
    parsed = df.withColumn("_parsed", F.from_json(payload, fields))
    typed = []
    for field in fields.fieldNames():
        column = F.col("_parsed")[field]
        if field in defaults:
            column = F.coalesce(column, F.lit(defaults[field]).cast(fields[field].dataType))
        typed.append(column.alias(field))
    kept = [c for c in df.columns if keep_payload or c != payload]
    return parsed.select(*kept, *typed)


def variant_props(
    df: DataFrame, fields: Mapping[str, tuple[str, str]], payload: str = "props", keep_payload: bool = False,
) -> DataFrame:
    """JSON text as typed columns, by ``{name: (path, type)}``, whatever shape each payload has.

    The text is parsed once into a variant. A value is cast if it can be, a number in quotes
    too; a path that is not there, a value of another kind and text that is no JSON give null.
    """
    parsed = df.withColumn("_variant", F.try_parse_json(payload))
    kept = [c for c in df.columns if keep_payload or c != payload]
    return parsed.select(*kept, *[F.try_variant_get("_variant", path, kind).alias(n) for n, (path, kind) in fields.items()])


def payload_drift(df: DataFrame, by: Sequence[str], payload: str = "props") -> DataFrame:
    """Per group ``records``, those whose payload is no JSON, and the type that holds all other payloads.

    Types of a group's payloads are merged task by task: fields that some lack are in it,
    and fields of several kinds are ``VARIANT``.
    """
    variant = F.try_parse_json(payload)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col(payload).isNotNull() & variant.isNull()).alias("unreadable"),
        F.schema_of_variant_agg(variant).alias("payload_type"))


def _expand(template: str, source: Column, pattern: str) -> Column:
    """Rule output name with ``$n`` replaced by the n-th capture group."""
    pieces = re.split(r"\$(\d+)", template)
    return F.concat(*[
        F.regexp_extract(source, pattern, int(p)) if i % 2 else F.lit(p)
        for i, p in enumerate(pieces)
    ])


def relabel(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    source: str = "source_name",
    lowercase: bool = True,
) -> DataFrame:
    """Add ``metric`` and ``kind`` from ordered (pattern, name, kind) rules.

    The first matching rule wins; names that no rule matches are dropped.
    """
    text = F.col(source)
    metric = kind = F.lit(None).cast("string")
    for pattern, name, declared in reversed(list(rules)):
        hit = text.rlike(pattern)
        new_name = _expand(name, text, pattern)
        metric = F.when(hit, F.lower(new_name) if lowercase else new_name).otherwise(metric)
        kind = F.when(hit, declared.lower()).otherwise(kind)
    return df.withColumns({"metric": metric, "kind": kind}).filter(F.col("metric").isNotNull())


def stable_id(columns: Sequence[str | Column]) -> Column:
    """First 16 hex digits of the sha256 of the pipe-joined values; a null reads ``None``."""
    texts = [
        F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("None"))
        for c in columns
    ]
    return F.substring(F.sha2(F.concat_ws("|", *texts).cast("binary"), 256), 1, 16)


def json_error(value: str | Column, schema: str | StructType) -> tuple[Column, Column]:
    """(payload typed by ``schema``, why it is not: null, missing_payload, malformed_json or wrong_type).

    A payload is good if it is exactly one JSON object whose fields fit. Text behind the
    object, a second object or an array make it malformed; a field of another type makes
    it ``wrong_type``. The text is read inside an array and inside an object: what ends
    the one early does not end the other. Of a key that an object repeats the last value
    counts; that alone is no error.
    """
    text = F.col(value) if isinstance(value, str) else value
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    corrupt = "_corrupt_record"
    options = {"columnNameOfCorruptRecord": corrupt, "mode": "PERMISSIVE",
               "timestampFormat": ISO_TIME, "timestampNTZFormat": ISO_TIME}
    parsed = F.from_json(text, StructType(fields.fields).add(corrupt, StringType()), options)
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    held = F.from_json(F.concat(F.lit('{"r":'), text, F.lit("}")), f"r string, {corrupt} string", options)
    one = (F.size(listed) == 1) & held[corrupt].isNull() & F.ltrim(held["r"]).startswith("{")
    error = (
        F.when(text.isNull() | (F.trim(text) == ""), "missing_payload")
        .when(~F.coalesce(one, F.lit(False)), "malformed_json")
        .when(parsed[corrupt].isNotNull(), "wrong_type")
    )
    return parsed, error
