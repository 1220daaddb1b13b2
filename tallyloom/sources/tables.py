"""Partitioned Parquet tables and the jobs that write them. Every job can be rerun."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.timeaxis import calendar, is_ntz
from . import files

_GRAINS = {"day": ("event_date", lambda ts: F.to_date(ts)),
           "month": ("event_month", lambda ts: F.date_format(ts, "yyyyMM"))}


def write_events(
    df: DataFrame, path: str, grain: str = "day", ts: str = "ts",
    cluster_by: Sequence[str] = (), files_hint: int | None = None, mode: str = "overwrite",
) -> str:
    """Write partitioned by day or month, sorted inside so that filters skip row groups.

    Rows are spread by ranges of (partition, cluster columns, time, row hash): a large
    day is cut over many tasks, also if its cluster columns are all alike, and a small
    one stays in one file. Returns the partition column.
    """
    column, derive = _GRAINS[grain]
    layout = [column, *cluster_by, *([] if ts in cluster_by else [ts])]
    rows = df.withColumn(column, derive(F.col(ts)))
    ranges = [*[F.col(c) for c in layout], F.xxhash64(*df.columns)]
    spread = (
        rows.repartitionByRange(*ranges) if files_hint is None
        else rows.repartitionByRange(files_hint, *ranges)
    )
    spread.sortWithinPartitions(*layout).write.mode(mode).partitionBy(column).parquet(path)
    return column


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions that occur in ``df``; others keep their files.

    The new files are moved in when the job commits, so a job that fails before that
    leaves the old partitions, and a retry cannot duplicate rows. The move itself is one
    rename per partition on a file system; on object stores, which copy, a reader may see
    it half done and a crash within it calls for a rerun. The rebalance hint gathers a
    small partition into one file and splits a large one by size, whatever its keys.
    """
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def overwrite_partition(
    df: DataFrame, path: str, run_date: str, partition: str = "run_date"
) -> None:
    """Write one run's partition again. A run without rows leaves the partition empty."""
    spark = df.sparkSession
    folder = f"{path}/{partition}={run_date}"
    before = files.file_names(spark, folder)
    rows = df.drop(partition).withColumn(partition, F.lit(run_date).cast("date"))
    overwrite_partitions(rows, path, partition)
    if before and files.file_names(spark, folder) == before:
        files.remove(spark, folder)


def _observed(df: DataFrame, seen: Observation, names: Sequence[str]) -> dict:
    """What a write observed. An input that Spark finds empty while planning reports nothing;
    any other failure to report is an error."""
    try:
        return seen.get
    except Py4JJavaError:
        if not df.isEmpty():
            raise
        return {name: 0 if name == "rows" else None for name in names}


class ChecksFailed(ValueError):
    """Staged data did not pass; nothing was promoted."""


def stage_and_promote(
    df: DataFrame, path: str, partition: str, checks: Mapping[str, Column],
    staging: str | None = None,
) -> dict[str, bool]:
    """Write to a run's own folder, evaluate the checks on it, then replace partitions.

    Each check is a boolean aggregate. All are evaluated in one pass over the
    staged files; if one is not true the target is left alone.
    """
    spark = df.sparkSession
    stage = staging or f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(stage)
    staged = spark.read.parquet(stage)
    outcome = staged.agg(*[c.alias(n) for n, c in checks.items()]).first().asDict()
    failed = sorted(n for n, passed in outcome.items() if passed is not True)
    if failed:
        raise ChecksFailed(f"checks failed on {stage}: {', '.join(failed)}")
    overwrite_partitions(staged, path, partition)
    files.remove(spark, stage)
    return outcome


def upsert(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Base with the last write of every changed key; ties go to the later ``order_by`` columns.

    Only rows of changed keys are compared. If the changed keys are few enough for
    Spark to broadcast, the base is never shuffled.
    """
    columns = base.columns
    changed = changes.select(*keys).distinct()
    untouched = base.join(changed, list(keys), "left_anti").select(*columns)
    rivals = base.join(changed, list(keys), "left_semi").select(*columns).unionByName(
        changes.select(*columns))
    return untouched.unionByName(last_of(rivals, keys, order_by))


def last_of(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Of each key the row with the largest ``order_by``; ties go to the other columns."""
    order = [*order_by, *[c for c in rows.columns if c not in keys and c not in order_by]]
    return (
        rows.groupBy(*keys)
        .agg(F.max(F.struct(*order)).alias("_last"))
        .select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])
    )


def backfill(src: DataFrame, path: str, columns: Mapping[str, Column] | Sequence[str],
             partition: str | None = None) -> DataFrame:
    """Copy into a table of a new shape and compare: ``source_rows``, ``target_rows``, ``equal``.

    The source is counted while it is written, the target from its file footers.
    """
    spark = src.sparkSession
    shape = (
        [c.alias(n) for n, c in columns.items()] if isinstance(columns, Mapping)
        else [F.col(c) for c in columns]
    )
    seen = Observation()
    writer = src.observe(seen, F.count(F.lit(1)).alias("rows")).select(*shape).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.parquet(path).agg(
        F.lit(_observed(src, seen, ["rows"])["rows"]).cast("long").alias("source_rows"),
        F.count(F.lit(1)).alias("target_rows"),
    ).withColumn("equal", F.col("source_rows") == F.col("target_rows"))


def daily_summary(
    df: DataFrame, run_date: str, by: Sequence[str], measure: str, ts: str = "ts"
) -> DataFrame:
    """Count and mean per group for one closed day, stamped with ``run_date``."""
    day = date.fromisoformat(run_date)
    return _summaries(df, day, day + timedelta(days=1), by, measure, ts)


def _summaries(df: DataFrame, start: date, end: date, by: Sequence[str], measure: str, ts: str
               ) -> DataFrame:
    kind = "timestamp_ntz" if is_ntz(df, ts) else "timestamp"
    first, last = F.lit(str(start)).cast(kind), F.lit(str(end)).cast(kind)
    return (
        df.filter((F.col(ts) >= first) & (F.col(ts) < last))
        .groupBy(F.to_date(ts).alias("run_date"), *by)
        .agg(F.count(F.lit(1)).alias("rows"), F.avg(measure).alias("avg_value"))
    )


def backfill_days(
    df: DataFrame, path: str, start: str, end: str, by: Sequence[str], measure: str, ts: str = "ts"
) -> None:
    """Summaries of every day in ``[start, end)``, all in one job; days already there are replaced.

    Days of the range without rows lose their partition, as a run of their own would do.
    """
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = [f"run_date={first + timedelta(days=i)}" for i in range((last - first).days)]
    with _without_leftovers(df.sparkSession, path, days):
        overwrite_partitions(_summaries(df, first, last, by, measure, ts), path, "run_date")


@contextmanager
def _without_leftovers(spark: SparkSession, path: str, folders: Sequence[str]) -> Iterator[None]:
    """Of these partition folders, those that a write gives no new files are removed after it."""
    there = set(files.subfolders(spark, path))
    before = {name: files.file_names(spark, f"{path}/{name}") for name in folders if name in there}
    yield
    for name, old in before.items():
        if files.file_names(spark, f"{path}/{name}") == old:
            files.remove(spark, f"{path}/{name}")


def _on_days(df: DataFrame, days: Sequence[date], ts: str) -> Column:
    """Rows of these days as time ranges, which the scan can use to skip row groups."""
    kind = df.schema[ts].dataType
    ranges: list[list[date]] = []
    for day in sorted(days):
        if ranges and ranges[-1][1] == day:
            ranges[-1][1] = day + timedelta(days=1)
        else:
            ranges.append([day, day + timedelta(days=1)])
    inside = F.lit(False)
    for start, end in ranges:
        inside = inside | (
            (F.col(ts) >= F.lit(str(start)).cast(kind)) & (F.col(ts) < F.lit(str(end)).cast(kind)))
    return inside


def refresh_rollup(
    raw: DataFrame, changed: DataFrame, path: str, by: Sequence[str], measure: str,
    grain: str = "hour", ts: str = "ts", day_partition: str | None = None,
) -> None:
    """Bring a rollup table up to date: only days with changed rows are computed again.

    Rows per (bucket, group): count, sum and mean of the measure; partitioned by day. A
    changed day that has no raw rows left loses its partition.
    The changed days, a list no longer than the calendar, become time ranges on the
    raw table, and a filter on its day partition column if it has one.
    """
    days = [r[0] for r in changed.select(F.to_date(ts)).distinct().collect() if r[0] is not None]
    touched = raw.filter(_on_days(raw, days, ts))
    if day_partition:
        touched = touched.filter(F.col(day_partition).isin(days))
    fresh = touched.groupBy(
        F.to_date(ts).alias("day"), calendar(ts, grain, is_ntz(raw, ts)).alias("bucket"), *by
    ).agg(F.count(F.lit(1)).alias("rows"), F.sum(measure).alias("total"), F.avg(measure).alias("mean"))
    with _without_leftovers(raw.sparkSession, path, [f"day={day}" for day in days]):
        overwrite_partitions(fresh, path, "day")


def layout_audit(spark: SparkSession, path: str, small_file: int = 16 * 1024 * 1024) -> DataFrame:
    """Files, rows and bytes per partition folder, largest first, with the small-file share.

    Only the scan's file metadata is selected, so no column is read.
    """
    per_file = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    # a path is escaped by %XX alone: a plus sign in it is one
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(plain, r"((?:/[^/=]+=[^/]+)*)/[^/]+$", 1)
    return (
        per_file.groupBy(F.ltrim(folder, F.lit("/")).alias("partition"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("_rows").alias("rows"),
            F.sum("size").alias("bytes"),
            F.count_if(F.col("size") < small_file).alias("small_files"),
        )
        .orderBy(F.col("bytes").desc(), "partition")
    )


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per Spark partition: what a write of this frame would put in each file."""
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(
        F.count(F.lit(1)).alias("rows"))


def materialize(
    df: DataFrame, path: str, evidence_path: str, asset: str, owner: str, run_id: str,
    partition: str, ts: str = "ts",
) -> DataFrame:
    """Write the output and append one evidence row; returns that row.

    The counts are observed while writing, so the output is not read again. The
    evidence of a run is its own folder: repeating the run replaces it.
    """
    spark = df.sparkSession
    seen = Observation()
    observed = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    overwrite_partitions(observed, path, partition)
    facts = _observed(df, seen, ["rows", "first", "last"])
    row = spark.range(1).select(
        F.lit(asset).alias("asset"), F.lit(owner).alias("owner"),
        F.lit(partition).alias("partitioned_by"), F.lit(facts["rows"]).cast("long").alias("rows"),
        F.lit(facts["first"]).cast(df.schema[ts].dataType).alias("source_from"),
        F.lit(facts["last"]).cast(df.schema[ts].dataType).alias("source_to"),
    )
    target = f"{evidence_path}/run_id={run_id}"
    row.coalesce(1).write.mode("overwrite").parquet(target)
    return spark.read.option("basePath", evidence_path).parquet(target)


def _end_of(value: str) -> date:
    """The first day after a partition named by day (2024-01-31) or month (202401)."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return date.fromisoformat(value) + timedelta(days=1)
    if re.fullmatch(r"\d{6}", value):
        year, month = int(value[:4]), int(value[4:])
        return date(year + month // 12, month % 12 + 1, 1)
    raise ValueError(f"partition {value!r} is neither a day nor a month")


def retention_trim(spark: SparkSession, path: str, older_than: str, partition: str = "event_date"
                   ) -> list[str]:
    """Drop the day or month partitions that end before ``older_than``.

    A listing and deletes, no data is read. Rows without a date stay; a partition named
    in another way is an error, and then nothing is dropped.
    """
    limit, prefix = date.fromisoformat(older_than), f"{partition}="
    named = [n for n in files.subfolders(spark, path) if n.startswith(prefix) and "__HIVE" not in n]
    expired = [name for name in named if _end_of(name.removeprefix(prefix)) <= limit]
    for name in expired:
        files.remove(spark, f"{path}/{name}")
    return expired


def replace_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Create a table from a query, or replace the one there; a rerun leaves one copy.

    The rows are written beside the table first, so the query may read the table it
    replaces, and a query that fails leaves it. The swap is two renames, between which a
    reader finds no table; if the second fails the old table is put back. A crash between
    them leaves the old table as ``<path>-old-...``. Object stores copy on a rename.
    """
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(fresh)
    _swap(spark, fresh, path.rstrip("/"))


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a folder in the place of another, which goes, or comes back if that fails."""
    old = f"{fresh}-old"
    there = files.exists(spark, path)
    if there:
        files.rename(spark, path, old)
    try:
        files.rename(spark, fresh, path)
    except Exception:
        if there:
            files.rename(spark, old, path)
        raise
    if there:
        files.remove(spark, old)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def compact(spark: SparkSession, path: str, partition: str, small_file: int = 16 * 1024 * 1024) -> list[str]:
    """Rewrite the partitions that have more than one small file; returns their folder names.

    Finds them by the layout audit. Rows are gathered by size, so large partitions keep
    several files; partitions in good shape are neither read nor written. Partition values
    are kept as the texts their folders say, and nested partitions stay nested. The new
    files are written beside the table and a folder is put in place only once all of them hold
    as many rows as before.
    """
    path = path.rstrip("/")
    audit = layout_audit(spark, path, small_file).filter(
        (F.col("small_files") > 1) & F.startswith("partition", F.lit(f"{partition}="))).collect()
    rows_of = {row["partition"]: row["rows"] for row in audit}
    crowded = sorted(rows_of)
    if not crowded:
        return []
    levels = [level.split("=", 1)[0] for level in crowded[0].split("/")]
    with _setting(spark, "spark.sql.sources.partitionColumnTypeInference.enabled", "false"):
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/{name}" for name in crowded])
    fresh = f"{path}-compact-{uuid.uuid4().hex}"
    rows.hint("rebalance", *levels).write.partitionBy(*levels).parquet(fresh)
    written = {row["partition"]: row["rows"] for row in layout_audit(spark, fresh, small_file).collect()}
    if written != rows_of:
        files.remove(spark, fresh)
        raise ValueError(f"rewriting {path} changed its partitions: {rows_of} became {written}")
    for name in crowded:
        # beside the table: a folder inside would be read as part of it
        moved = f"{fresh}-{uuid.uuid4().hex}"
        files.rename(spark, f"{fresh}/{name}", moved)
        _swap(spark, moved, f"{path}/{name}")
    files.remove(spark, fresh)
    return crowded


def save_report(df: DataFrame, path: str) -> None:
    """A small summary as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
