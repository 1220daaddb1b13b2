"""Table jobs: each writes under the shared folder and returns the table read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..sources import bucketed, ingest, rollups, tables
from ..functions.timeaxis import interval
from . import ORACLE_SQL, query
from .inputs import table

_EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_BAD = "event_id % 50 = 0"


def _json_lines(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines; some lines are cut off."""
    path = scratch_path(spark, "events-jsonl")
    line = F.to_json(F.struct("*"), {"timestampNTZFormat": _ISO})
    lines = table(spark, sf_dir, "events").select(
        F.when(F.expr(_BAD), F.substring(line, 1, 30)).otherwise(line).alias("value"))
    lines.write.text(path)
    return path


def _csv_lines(spark: SparkSession, sf_dir: str) -> str:
    """Events as CSV with a header; some rows have a value that is no number."""
    path = scratch_path(spark, "events-csv")
    value = F.when(F.expr(_BAD), "n/a").otherwise(F.col("value").cast("string"))
    table(spark, sf_dir, "events").withColumn("value", value).write.option("header", True).option(
        "escape", '"').option("timestampNTZFormat", _ISO).csv(path)
    return path


@query("SELECT * FROM events WHERE event_id % 50 <> 0")
def ingest_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_jsonl(spark, _json_lines(spark, sf_dir), _EVENT_SCHEMA)[0]


@query("SELECT event_id FROM events WHERE event_id % 50 = 0")
def ingest_jsonl_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ingest.ingest_jsonl(spark, _json_lines(spark, sf_dir), _EVENT_SCHEMA)[1]
    return bad.select(F.regexp_extract("record", r'"event_id":(\d+)', 1).cast("long").alias("event_id"))


@query("SELECT * FROM events WHERE event_id % 50 <> 0")
def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_csv(spark, _csv_lines(spark, sf_dir), _EVENT_SCHEMA)[0]


@query("SELECT event_id FROM events WHERE event_id % 50 = 0")
def ingest_csv_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ingest.ingest_csv(spark, _csv_lines(spark, sf_dir), _EVENT_SCHEMA)[1]
    return bad.select(F.split("record", ",")[0].cast("long").alias("event_id"))


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 50 <> 0")
def ingest_csv_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one folder that name their columns in different orders, one with a column more."""
    path = scratch_path(spark, "events-csv")
    value = F.when(F.expr(_BAD), "n/a").otherwise(F.col("value").cast("string"))
    events = table(spark, sf_dir, "events").withColumn("value", value)
    for part, columns in enumerate((["event_id", "event_type", "value"], ["value", "event_id", "event_type"],
                                    ["event_type", "props", "value", "event_id"])):
        events.filter(F.col("event_id") % 3 == part).select(columns).write.mode("append").option("header", True).option(
            "escape", '"').csv(path)
    return ingest.ingest_csv(spark, path, "event_id long, event_type string, value double")[0]


@query("""SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS event_date FROM events""")
def write_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-by-day")
    tables.write_events(table(spark, sf_dir, "events"), path, "day", cluster_by=["event_type"])
    return spark.read.parquet(path)


@query("""SELECT event_id, user_id, CAST(strftime(ts, '%Y%m') AS INTEGER) AS event_month FROM events
WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'""")
def write_events_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read by the leading sort columns, so row groups are skipped."""
    path = scratch_path(spark, "events-by-month")
    tables.write_events(table(spark, sf_dir, "events"), path, "month", cluster_by=["event_type"])
    return spark.read.parquet(path).filter(
        (F.col("event_type") == "error")
        & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
        & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))
    ).select("event_id", "user_id", "event_month")


@query("""SELECT event_id, event_type, round(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN value * 2 ELSE value END, 6) AS value,
  CAST(ts AS DATE) AS run_date FROM events
WHERE NOT (CAST(ts AS DATE) = DATE '2024-01-12')""")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day written again, twice, and one day whose rerun has no rows."""
    path = scratch_path(spark, "daily-output")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", F.to_date("ts").alias("run_date"))
    tables.overwrite_partitions(rows, path, "run_date")
    again = rows.filter("run_date = DATE '2024-01-10'").withColumn("value", F.col("value") * 2)
    for _ in range(2):
        tables.overwrite_partition(again, path, "2024-01-10")
    tables.overwrite_partition(rows.filter(F.lit(False)), path, "2024-01-12")
    return spark.read.parquet(path).withColumn("value", F.round("value", 6))


@query("SELECT event_id, value, CAST(ts AS DATE) AS run_date FROM events")
def stage_and_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A good stage is promoted; one with a negative value is refused and changes nothing."""
    path = scratch_path(spark, "promoted")
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.to_date("ts").alias("run_date"))
    checks = {
        "has_rows": F.count(F.lit(1)) > 0,
        "no_null_ids": F.count_if(F.col("event_id").isNull()) == 0,
        "values_in_range": F.min("value") >= 0,
    }
    tables.stage_and_promote(rows, path, "run_date", checks)
    try:
        tables.stage_and_promote(rows.withColumn("value", -F.col("value") - 1), path, "run_date", checks)
    except tables.ChecksFailed:
        pass
    return spark.read.parquet(path)


@query("""WITH changes AS (
  SELECT event_id, ts + INTERVAL 1 SECOND AS ts, event_type, value * 2 AS value FROM events WHERE event_id % 10 = 0
  UNION ALL SELECT event_id, ts - INTERVAL 1 SECOND, event_type, -1 FROM events WHERE event_id % 15 = 0
  UNION ALL SELECT event_id + 1000000000000, ts, event_type, value FROM events WHERE event_id % 25 = 0),
everything AS (SELECT event_id, ts, event_type, value FROM events UNION ALL SELECT * FROM changes)
SELECT event_id, ts, event_type, round(value, 6) AS value FROM everything
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, value DESC) = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later changes win, earlier ones lose, new keys are added."""
    base, changes = _base_and_changes(spark, sf_dir)
    return tables.upsert(base, changes, ["event_id"], ["ts", "value"]).withColumn("value", F.round("value", 6))


def _base_and_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    second = interval(1)
    later = base.filter("event_id % 10 = 0").withColumns(
        {"ts": F.col("ts") + second, "value": F.col("value") * 2})
    stale = base.filter("event_id % 15 = 0").withColumns(
        {"ts": F.col("ts") - second, "value": F.lit(-1.0)})
    new = base.filter("event_id % 25 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000_000)
    return base, later.unionByName(stale).unionByName(new)


@query(ORACLE_SQL["upsert_latest"])
def upsert_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of ``upsert_latest`` on a table in buckets of its key, applied in two steps."""
    base, changes = _base_and_changes(spark, sf_dir)
    name, keys = f"events_{uuid.uuid4().hex}", ["event_id"]
    bucketed.write_bucketed(base, name, scratch_path(spark, "bucketed"), keys, 8)
    for part in range(2):
        merged = bucketed.upsert_bucketed(spark, name, changes.filter(F.col("event_id") % 2 == part), keys, ["ts", "value"])
        bucketed.replace_bucketed(spark, merged, name, scratch_path(spark, "bucketed"), keys, 8)
    return spark.table(name).withColumn("value", F.round("value", 6))


@query("SELECT count(*) AS source_rows, count(*) AS target_rows, true AS equal FROM events")
def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.backfill(table(spark, sf_dir, "events"), scratch_path(spark, "events-v2"), {
        "ts": F.col("ts"), "tenant": F.lit("shop"), "event": F.col("event_type"),
        "user_id": F.col("user_id").cast("string"), "duration_ms": F.round("value").cast("long")})


@query("""SELECT CAST(ts AS DATE) AS run_date, event_type, count(*) AS rows, round(avg(value), 9) AS avg_value
FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2""")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = tables.daily_summary(table(spark, sf_dir, "events"), "2024-01-15", ["event_type"], "value")
    return summary.withColumn("avg_value", F.round("avg_value", 9))


@query("""SELECT CAST(ts AS DATE) AS run_date, event_type, count(*) AS rows, round(avg(value), 9) AS avg_value
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def backfill_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen days in one job, five of them a second time."""
    path = scratch_path(spark, "summaries")
    events = table(spark, sf_dir, "events")
    tables.backfill_days(events, path, "2024-01-05", "2024-01-20", ["event_type"], "value")
    tables.backfill_days(events, path, "2024-01-08", "2024-01-13", ["event_type"], "value")
    return spark.read.parquet(path).withColumn("avg_value", F.round("avg_value", 9))


@query("""SELECT 'event_date=' || CAST(ts AS DATE) AS partition, count(*) AS rows, true AS has_bytes, true AS small
FROM events GROUP BY 1, 3, 4""")
def layout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and byte counts depend on the session, so only their presence is returned."""
    path = scratch_path(spark, "audited")
    tables.write_events(table(spark, sf_dir, "events"), path, "day")
    audit = tables.layout_audit(spark, path)
    return audit.select("partition", "rows", (F.col("bytes") > 0).alias("has_bytes"),
                        (F.col("small_files") == F.col("files")).alias("small"))


@query("""SELECT 'daily_events' AS asset, 'data-platform' AS owner, 'run_date' AS partitioned_by, count(*) AS rows,
  min(ts) AS source_from, max(ts) AS source_to FROM events""")
def materialize_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("run_date", F.to_date("ts"))
    evidence = tables.materialize(
        events, scratch_path(spark, "asset"), scratch_path(spark, "evidence"), "daily_events",
        "data-platform", "run-1", "run_date")
    return evidence.drop("run_id")


@query("""SELECT CAST(ts AS DATE) AS event_date, count(*) AS rows FROM events
WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1""")
def retention_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "retained")
    tables.write_events(table(spark, sf_dir, "events"), path, "day")
    tables.retention_trim(spark, path, "2024-01-24")
    return spark.read.parquet(path).groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT CAST(strftime(ts, '%Y%m') AS INTEGER) AS event_month, count(*) AS rows FROM (
  SELECT ts FROM events UNION ALL SELECT ts - INTERVAL 40 DAY FROM events) WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1""")
def retention_trim_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of this month and earlier ones, by month; months that ended before it go."""
    path = scratch_path(spark, "retained")
    events = table(spark, sf_dir, "events")
    earlier = events.withColumn("ts", F.col("ts") - F.expr("interval 40 days"))
    tables.write_events(events.unionByName(earlier), path, "month")
    tables.retention_trim(spark, path, "2024-01-15", "event_month")
    return spark.read.parquet(path).groupBy("event_month").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS rows FROM events
WHERE CAST(ts AS DATE) <> DATE '2024-01-09' GROUP BY 1, 2""")
def rollup_emptied_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day whose raw rows are all gone is gone from the rollup after its refresh."""
    path = scratch_path(spark, "rollup")
    events = table(spark, sf_dir, "events")
    tables.refresh_rollup(events, events, path, ["event_type"], "value")
    emptied = F.to_date("ts") == F.lit("2024-01-09").cast("date")
    tables.refresh_rollup(events.filter(~emptied), events.filter(emptied), path, ["event_type"], "value")
    return spark.read.parquet(path).groupBy("day", "event_type").agg(F.sum("rows").alias("rows"))


@query("""WITH final AS (
  SELECT ts, event_type, CASE WHEN event_id % 7 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE event_id % 11 <> 0)
SELECT CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS bucket, event_type, count(*) AS rows,
  round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM final GROUP BY 1, 2, 3""")
def rollup_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded, added to, updated, folded, deleted from, and one batch sent again: always only by changes."""
    path = scratch_path(spark, "rollup")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    late, doubled = events.filter("event_id % 10 = 3"), events.filter("event_id % 7 = 0")
    gone = events.filter("event_id % 11 = 0").withColumn(
        "value", F.when(F.col("event_id") % 7 == 0, F.col("value") * 2).otherwise(F.col("value")))
    batches = [rollups.changes(events.filter("event_id % 10 <> 3")), rollups.changes(late),
               rollups.changes(doubled.withColumn("value", F.col("value") * 2), doubled), rollups.changes(deleted=gone)]
    for number, batch in enumerate(batches):
        rollups.apply_changes(batch, path, ["event_type"], "value", f"batch-{number}")
        if number == 2:
            rollups.fold(spark, path)
            rollups.apply_changes(batches[1], path, ["event_type"], "value", "batch-1")
    return rollups.read_rollup(spark, path).withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6)})


@query("SELECT event_id, event_type, round(value * 2, 6) AS value FROM events WHERE event_id % 2 = 0")
def replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made from a query, twice, then replaced by a query on itself."""
    path = scratch_path(spark, "replaced")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for _ in range(2):
        tables.replace_table(events, path)
    doubled = spark.read.parquet(path).filter("event_id % 2 = 0").withColumn("value", F.col("value") * 2)
    tables.replace_table(doubled, path)
    return spark.read.parquet(path).withColumn("value", F.round("value", 6))


@query("""SELECT CAST(ts AS DATE) AS event_date, count(*) AS rows, 1 AS files FROM events GROUP BY 1""")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written in four appends have one file each afterwards, and the same rows."""
    path = scratch_path(spark, "crowded")
    events = table(spark, sf_dir, "events")
    for part in range(4):
        tables.write_events(events.filter(F.col("event_id") % 4 == part), path, "day", files_hint=1, mode="append")
    tables.compact(spark, path, "event_date")
    found = spark.read.parquet(path).select("event_date", F.col("_metadata.file_path").alias("file"))
    return found.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("file").cast("int").alias("files"))


@query("""SELECT CASE user_id % 4 WHEN 0 THEN '007' WHEN 1 THEN 'a+b c' WHEN 2 THEN '1e3' END AS shop, count(*) AS rows, 1 AS files
FROM events GROUP BY 1""")
def compact_text_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions whose names read like numbers, hold signs or are null keep their names and rows."""
    path = scratch_path(spark, "crowded")
    shop = F.when(F.col("user_id") % 4 == 0, "007").when(F.col("user_id") % 4 == 1, "a+b c").when(F.col("user_id") % 4 == 2, "1e3")
    events = table(spark, sf_dir, "events").withColumn("shop", shop)
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").partitionBy("shop").parquet(path)
    tables.compact(spark, path, "shop")
    found = spark.read.schema("event_id long, shop string").parquet(path).select("shop", F.col("_metadata.file_path").alias("file"))
    return found.groupBy("shop").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("file").cast("int").alias("files"))


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    tables.save_report(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows")), path)
    return spark.read.schema("event_type string, rows long").csv(path, header=True)


@query("SELECT event_id, event_type FROM events")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "appended")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    events.filter(early).write.parquet(path)
    events.filter(~early).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("event_id", "event_type")
