"""Table jobs: reruns change nothing, failures promote nothing, and the known small answers."""

import pytest
from pyspark.sql import Row, functions as F

from tallyloom.sources import files, ingest, tables


def days(spark, rows):
    return spark.createDataFrame(rows, "id int, d string, v double").withColumn("run_date", F.to_date("d")).drop("d")


def content(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("id", "v", F.col("run_date").cast("string")).collect())


def test_rerun_of_one_day_leaves_the_others(spark, folder):
    path = folder("daily")
    rows = days(spark, [(1, "2024-01-01", 1.0), (2, "2024-01-02", 2.0)])
    tables.overwrite_partitions(rows, path, "run_date")
    before = content(spark, path)
    for _ in range(3):
        tables.overwrite_partition(rows.filter("id = 2"), path, "2024-01-02")
    assert content(spark, path) == before
    tables.overwrite_partition(rows.filter("id = 99"), path, "2024-01-02")
    assert content(spark, path) == before[:1]


def test_failed_check_promotes_nothing(spark, folder):
    path = folder("checked")
    rows = days(spark, [(1, "2024-01-01", 1.0)])
    tables.stage_and_promote(rows, path, "run_date", {"some": F.count(F.lit(1)) > 0})
    with pytest.raises(tables.ChecksFailed, match="positive"):
        tables.stage_and_promote(
            rows.withColumn("v", F.lit(-1.0)), path, "run_date",
            {"some": F.count(F.lit(1)) > 0, "positive": F.min("v") >= 0})
    with pytest.raises(tables.ChecksFailed):
        tables.stage_and_promote(rows.filter("id = 9"), path, "run_date", {"positive": F.min("v") >= 0})
    assert content(spark, path) == [(1, 1.0, "2024-01-01")]


def test_upsert_twice_is_upsert_once(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (None, 1, "n")], "id int, t int, s string")
    changes = spark.createDataFrame([(2, 2, "B"), (2, 0, "old"), (3, 1, "c")], "id int, t int, s string")
    once = tables.upsert(base, changes, ["id"], ["t"])
    twice = tables.upsert(once, changes, ["id"], ["t"])
    expected = [(1, 1, "a"), (2, 2, "B"), (3, 1, "c"), (None, 1, "n")]
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))
    assert key(once) == key(twice) == expected


def test_upsert_of_few_changes_does_not_shuffle_the_base(spark, folder):
    path, changed = folder("base"), folder("changes")
    spark.range(1000).select("id", F.lit(0).alias("t")).write.parquet(path)
    spark.createDataFrame([(5, 1)], "id long, t int").write.parquet(changed)
    plan = tables.upsert(spark.read.parquet(path), spark.read.parquet(changed), ["id"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "LeftAnti" in plan


def test_backfilled_day_without_rows_goes_away(spark, folder):
    path = folder("summaries")
    rows = spark.createDataFrame(
        [("a", "2024-01-01 05:00:00", 1.0), ("a", "2024-01-02 05:00:00", 3.0)], "k string, t string, v double"
    ).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    tables.backfill_days(rows, path, "2024-01-01", "2024-01-03", ["k"], "v")
    tables.backfill_days(rows.filter("v < 2"), path, "2024-01-01", "2024-01-03", ["k"], "v")
    assert [str(r.run_date) for r in spark.read.parquet(path).collect()] == ["2024-01-01"]
    closed = tables.daily_summary(rows, "2024-01-02", ["k"], "v").first()
    assert (closed["rows"], closed["avg_value"]) == (1, 3.0)


def test_rollup_reads_only_the_touched_days(spark, folder):
    raw_path, path = folder("raw"), folder("rollup")
    rows = spark.createDataFrame(
        [(f"2024-01-0{d} 0{h}:30:00", float(d * h)) for d in range(1, 8) for h in (1, 2)], "t string, v double"
    ).select(F.col("t").cast("timestamp_ntz").alias("ts"), "v", F.lit("k").alias("k"))
    tables.write_events(rows, raw_path, "day")
    raw = spark.read.parquet(raw_path)
    tables.refresh_rollup(raw, raw, path, ["k"], "v", day_partition="event_date")
    before = {n: files.file_names(spark, f"{path}/{n}") for n in files.subfolders(spark, path)}
    changed = raw.filter("v >= 10")
    tables.refresh_rollup(raw, changed, path, ["k"], "v", day_partition="event_date")
    touched = {f"day={r[0]}" for r in changed.select("event_date").distinct().collect()}
    after = {n: files.file_names(spark, f"{path}/{n}") for n in files.subfolders(spark, path)}
    assert {n for n in before if before[n] != after[n]} == touched == {f"day=2024-01-0{d}" for d in (5, 6, 7)}
    assert spark.read.parquet(path).count() == 14


def test_retention_drops_whole_days_only(spark, folder):
    path = folder("kept")
    rows = spark.createDataFrame([(i, f"2024-01-{i:02d} 10:00:00") for i in range(1, 6)], "id int, t string")
    tables.write_events(rows.withColumn("ts", F.col("t").cast("timestamp_ntz")), path, "day")
    assert tables.retention_trim(spark, path, "2024-01-04") == [f"event_date=2024-01-{d:02d}" for d in (1, 2, 3)]
    assert tables.retention_trim(spark, path, "2024-01-04") == []
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [4, 5]


def test_clustered_files_are_sorted(spark, folder):
    path = folder("clustered")
    rows = spark.range(500).select(
        (F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"))
    tables.write_events(rows, path, "month", cluster_by=["k"], files_hint=3)
    for name in spark.read.parquet(path).select("_metadata.file_path").distinct().collect():
        keys = [(r.k, r.ts) for r in spark.read.parquet(name[0]).collect()]
        assert keys == sorted(keys)
    assert files.subfolders(spark, path) == ["event_month=197001"]


def test_layout_audit_counts_files(spark, folder):
    path = folder("audit")
    rows = spark.range(30).withColumn("d", F.col("id") % 2)
    for _ in range(2):
        rows.coalesce(1).write.mode("append").partitionBy("d").parquet(path)
    audit = {r["partition"]: r for r in tables.layout_audit(spark, path).collect()}
    assert {k: (r["files"], r["rows"], r["small_files"]) for k, r in audit.items()} == {
        "d=0": (2, 30, 2), "d=1": (2, 30, 2)}
    assert sum(r["rows"] for r in tables.partition_sizes(rows.repartition(3)).collect()) == 30


def test_broken_record_stays_broken_whatever_is_selected(spark, folder):
    path = folder("csv")
    spark.createDataFrame([("id,v,s",), ("1,2.5,x",), ("2,oops,y",), ("3,1.0,z,extra",)], "l string").coalesce(
        1).write.text(path)
    good, bad = ingest.ingest_csv(spark, path, "id int, v double, s string")
    assert [r.id for r in good.select("id").collect()] == [1]
    assert [r.record for r in bad.collect()] == ["2,oops,y", "3,1.0,z,extra"]
    assert bad.count() == 2 and bad.select("file").distinct().count() == 1
    path = folder("jsonl")
    spark.createDataFrame([('{"id": 1, "v": 2}',), ('{"id": 2, "v": "x"}',), ("not json",)], "l string").write.text(path)
    good, bad = ingest.ingest_jsonl(spark, path, "id int, v int")
    assert [r.id for r in good.select("id").collect()] == [1] and bad.count() == 2


def test_empty_input_is_reported_as_no_rows(spark, folder):
    rows = days(spark, [(1, "2024-01-01", 1.0)]).withColumn("ts", F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"))
    nothing = rows.filter("id = 9")
    assert tables.materialize(nothing, folder("a"), folder("e"), "a", "me", "r", "run_date").first()["rows"] == 0
    counts = tables.backfill(nothing, folder("copy"), ["id"]).first()
    assert (counts["source_rows"], counts["target_rows"], counts["equal"]) == (0, 0, True)


def test_repeated_materialization_is_one_evidence_row(spark, folder):
    out, evidence = folder("asset"), folder("evidence")
    rows = days(spark, [(1, "2024-01-01", 1.0)]).withColumn("ts", F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"))
    for _ in range(2):
        row = tables.materialize(rows, out, evidence, "a", "me", "r1", "run_date").first()
    tables.materialize(rows, out, evidence, "a", "me", "r2", "run_date")
    assert row["rows"] == 1 and spark.read.parquet(evidence).count() == 2


# Small inputs whose answers are written down.

def test_ids_in_buckets(spark, folder):
    counts = spark.range(0, 100).withColumn("bucket", F.col("id") % 10).groupBy("bucket").count()
    path = folder("buckets")
    counts.write.parquet(path)
    assert [r["count"] for r in spark.read.parquet(path).collect()] == [10] * 10
    four = spark.range(0, 20).groupBy((F.col("id") % 4).alias("b")).count()
    assert [r["count"] for r in four.collect()] == [5] * 4


def test_average_score_by_team(spark):
    people = spark.createDataFrame([Row(name="Ada", team="math", score=10), Row(name="Grace", team="systems", score=12),
                                    Row(name="Katherine", team="math", score=15)])
    assert {r["team"]: r[1] for r in people.groupBy("team").avg("score").collect()} == {"math": 12.5, "systems": 12.0}


def test_rows_and_average_by_source_and_event(spark):
    rows = [("docs", "page_view", 1.0), ("docs", "page_view", 2.0), ("docs", "deploy", 1.0), ("other", "page_view", 10.0)]
    df = spark.createDataFrame(rows, "source string, event string, value double")
    found = df.groupBy("source", "event").agg(F.count("*"), F.avg("value")).orderBy("source", "event").collect()
    assert [tuple(r) for r in found] == [("docs", "deploy", 1, 1.0), ("docs", "page_view", 2, 1.5), ("other", "page_view", 1, 10.0)]


def test_create_append_and_replace(spark, folder):
    path = folder("numbers")
    numbers = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id bigint, label string")
    numbers.write.parquet(path)
    spark.createDataFrame([(4, "four"), (5, "five")], "id bigint, label string").write.mode("append").parquet(path)
    assert [r.id for r in spark.read.parquet(path).orderBy("id").collect()] == [1, 2, 3, 4, 5]
    numbers.write.mode("overwrite").parquet(path)
    assert spark.read.parquet(path).count() == 3


def test_every_line_is_good_or_bad(spark, folder):
    path = folder("jsonl")
    lines = ['{"id":1}', '{"id":4}trailing', '{"id":5} {"id":6}', "", '{"id":"x"}', "{", '{"id":7,"more":[1]}']
    spark.createDataFrame([(x,) for x in lines], "l string").coalesce(1).write.text(path)
    good, bad = ingest.ingest_jsonl(spark, path, "id int")
    assert sorted(r.id for r in good.collect()) == [1, 7]
    assert sorted((r.record, r.error_class) for r in bad.collect()) == sorted([
        ('{"id":4}trailing', "malformed_json"), ('{"id":5} {"id":6}', "malformed_json"),
        ('{"id":"x"}', "wrong_type"), ("{", "malformed_json")])


def test_half_a_quoted_value_is_bad(spark, folder):
    path = folder("csv")
    spark.createDataFrame([("id,s",), ('1,"a',), ('b"',), ('2,"say ""hi"", twice"',), ("3,x",)], "l string").coalesce(
        1).write.text(path)
    good, bad = ingest.ingest_csv(spark, path, "id int, s string")
    assert sorted(tuple(r) for r in good.collect()) == [(2, 'say "hi", twice'), (3, "x")]
    assert sorted(r.record for r in bad.collect()) == ['1,"a', 'b"']
    good, bad = ingest.ingest_csv(spark, path, "id int, s string", multiline=True)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "a\nb"), (2, 'say "hi", twice'), (3, "x")]
    assert bad.count() == 0


def test_months_are_trimmed_by_their_end(spark, folder):
    path = folder("months")
    spark.createDataFrame([(1, 202312), (2, 202401), (3, 202402), (4, 202403)], "id int, event_month int").write.partitionBy(
        "event_month").parquet(path)
    assert tables.retention_trim(spark, path, "2024-02-29", "event_month") == ["event_month=202312", "event_month=202401"]
    assert tables.retention_trim(spark, path, "2024-03-01", "event_month") == ["event_month=202402"]
    spark.createDataFrame([(1, "w5")], "id int, event_month string").write.mode("append").partitionBy("event_month").parquet(path)
    with pytest.raises(ValueError, match="neither"):
        tables.retention_trim(spark, path, "2030-01-01", "event_month")


def test_replaced_table_may_be_read_by_its_query(spark, folder):
    path = folder("replaced")
    tables.replace_table(spark.range(10), path)
    tables.replace_table(spark.read.parquet(path).filter("id < 3"), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division"):
        tables.replace_table(spark.range(3).selectExpr("id", "raise_error('Division') AS x"), path)
    assert spark.read.parquet(path).count() == 3


def test_only_crowded_partitions_are_rewritten(spark, folder):
    path = folder("crowded")
    rows = spark.range(40).selectExpr("id", "CASE WHEN id < 20 THEN 0 ELSE 1 END AS d")
    rows.coalesce(1).write.partitionBy("d").parquet(path)
    rows.filter("d = 1").coalesce(1).write.mode("append").partitionBy("d").parquet(path)
    before = files.file_names(spark, f"{path}/d=0")
    assert tables.compact(spark, path, "d") == ["d=1"]
    assert files.file_names(spark, f"{path}/d=0") == before
    assert spark.read.parquet(path).count() == 60
    assert len([n for n in files.file_names(spark, f"{path}/d=1") if n.endswith(".parquet")]) == 1


def test_compacted_partitions_keep_names_and_rows(spark, folder):
    """Text that reads like numbers, signs that paths escape, null, and two levels."""
    path = folder("crowded")
    values = ["007", "7", "a+b", "a b", "x%20y", "p/q", "k=v", None]
    rows = spark.createDataFrame([(i, v, i // 8 % 2) for i, v in enumerate(values * 3)], "id int, k string, n int")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").partitionBy("k", "n").parquet(path)
    read = lambda: sorted(
        (r["id"], str(r["k"]), r["n"]) for r in spark.read.schema("id int, k string, n int").parquet(path).collect())
    before, folders = read(), files.subfolders(spark, path)
    assert len(tables.compact(spark, path, "k")) == 2 * len(values)
    assert read() == before and files.subfolders(spark, path) == folders
    assert tables.compact(spark, path, "k") == []
    assert all(r["files"] == 1 for r in tables.layout_audit(spark, path).collect())


def test_compaction_that_would_change_rows_is_refused(spark, folder, monkeypatch):
    path = folder("crowded")
    for _ in range(2):
        spark.range(4).withColumn("k", F.lit("a")).coalesce(1).write.mode("append").partitionBy("k").parquet(path)
    audit, calls = tables.layout_audit, []

    def wrong(*args):
        calls.append(1)
        found = audit(*args)
        return found if len(calls) == 1 else found.withColumn("rows", F.lit(7).cast("long"))

    monkeypatch.setattr(tables, "layout_audit", wrong)
    with pytest.raises(ValueError, match="changed its partitions"):
        tables.compact(spark, path, "k")
    assert spark.read.parquet(path).count() == 8 and files.subfolders(spark, path) == ["k=a"]


def test_failed_swap_puts_the_old_table_back(spark, folder, monkeypatch):
    path = folder("replaced")
    tables.replace_table(spark.range(5), path)
    rename = files.rename

    def failing(session, old, new):
        if new == path and not old.endswith("-old"):
            raise OSError("no")
        rename(session, old, new)

    monkeypatch.setattr(files, "rename", failing)
    with pytest.raises(OSError):
        tables.replace_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("multiline", [False, True])
def test_csv_columns_go_by_each_files_header(spark, folder, multiline):
    """Other orders, further columns, quoted names, blank lines first, and records that equal the header."""
    path = folder("csv")
    for lines in (["a,b", "1,2", "a,b"], ["", '"b","a"', "2,1", "b,a", "x,3"], ["c,b,a", "9,2,1", "8,4"], ["a,b"]):
        spark.createDataFrame([(x,) for x in lines], "l string").coalesce(1).write.mode("append").text(path)
    spark.createDataFrame([("b,a",), ("6,5",)], "l string").coalesce(1).write.mode("append").option("compression", "gzip").text(path)
    good, bad = ingest.ingest_csv(spark, path, "a int, b int", multiline=multiline)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2), (1, 2), (1, 2), (5, 6)]
    assert sorted(r.record for r in bad.collect()) == ["8,4", "a,b", "b,a", "x,3"]
    assert good.columns == ["a", "b"] and good.select("b").count() == 4
    spark.createDataFrame([("a,z",), ("1,2",)], "l string").coalesce(1).write.mode("append").text(path)
    with pytest.raises(ValueError, match="does not name b"):
        ingest.ingest_csv(spark, path, "a int, b int", multiline=multiline)


def test_headers_with_marks_and_wide_names(spark, folder):
    path = folder("csv")
    for lines in (["\ufeffa,\ufebf", "1,2"], ["\ufebf,a", "2,1"]):
        spark.createDataFrame([(x,) for x in lines], "l string").coalesce(1).write.mode("append").text(path)
    good, _ = ingest.ingest_csv(spark, path, "a int, `\ufebf` int")
    assert [tuple(r) for r in good.collect()] == [(1, 2), (1, 2)]


def test_csv_of_nothing(spark, folder):
    path = folder("csv")
    spark.createDataFrame([], "l string").write.text(path)
    good, bad = ingest.ingest_csv(spark, path, "a int")
    assert good.count() == bad.count() == 0 and good.columns == ["a"]
