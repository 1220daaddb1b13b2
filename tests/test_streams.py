"""Streaming jobs: the same answer as a batch, state over restarts, and what happens to late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import streams
from tallyloom.plans.streams import _rocksdb
from tallyloom.sources import files
from tallyloom.streaming import audit, log as logs, sinks, stateful

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp_ntz, ok boolean"


def rows(spark, items):
    return spark.createDataFrame(
        [(i, k, T0 + timedelta(minutes=m), ok) for i, k, m, ok in items], SCHEMA)


class Feed:
    """A folder that grows between runs of one job."""

    def __init__(self, spark, folder, job, mode="append"):
        self.spark, self.job, self.mode = spark, job, mode
        self.source, self.sink, self.checkpoint = folder("source"), folder("sink"), folder("checkpoint")

    def run(self, items):
        rows(self.spark, items).coalesce(1).write.mode("append").parquet(self.source)
        schema = rows(self.spark, []).schema
        stream = logs.stream_files(self.spark, self.source, schema)
        return sinks.run_available(
            self.job(stream), self.checkpoint, sinks.idempotent_sink(self.sink), self.mode)

    def result_unordered(self, *columns):
        return [tuple(r) for r in sinks.appended(self.spark, self.sink).select(*columns).collect()]

    def result(self, *columns):
        return sorted(tuple(r) for r in sinks.appended(self.spark, self.sink).select(*columns).collect())


@pytest.mark.parametrize("salts", [1, 4])
def test_dedup_within_and_across_batches(spark, folder, salts):
    feed = Feed(spark, folder, lambda s: stateful.dedup(s, "id", "2 hours", salts=salts))
    feed.run([(1, "a", 0, True), (1, "a", 0, True), (2, "a", 1, True)])
    feed.run([(2, "a", 1, True), (3, "a", 2, True)])
    assert feed.result("id") == [(1,), (2,), (3,)]


def test_late_rows_are_dropped_and_counted(spark, folder):
    feed = Feed(spark, folder, lambda s: stateful.windowed_counts(s, "5 minutes", ["key"], watermark="10 minutes"), "update")
    feed.run([(1, "a", 0, True), (2, "a", 60, True)])
    feed.run([(i, "a", 1, True) for i in range(3, 13)] + [(13, "a", 61, True)])
    found = sinks.sink_table(spark, feed.sink, ["key", "window_start", "window_end"])
    assert sorted(r["events"] for r in found.collect()) == [1, 2]
    # ten late rows in one window are ten rows, and a second run counts no row twice
    stream = logs.stream_files(spark, feed.source, rows(spark, []).schema, max_files=1)
    late = [sinks.late_rows(stream, feed.checkpoint + "-late", feed.sink + "-late", "5m", watermark="10m").first()[0]
            for _ in range(2)]
    assert late == [10, 10]


def test_first_match_is_said_once(spark, folder):
    feed = Feed(spark, folder, lambda s: stateful.first_match(s, "key", F.col("ok"), "id"))
    with _rocksdb(spark):
        feed.run([(1, "a", 5, False), (2, "a", 9, True), (3, "a", 7, True), (4, "b", 1, False)])
        feed.run([(5, "a", 20, True), (6, "b", 21, True)])
    assert feed.result("key", "id") == [("a", 3), ("b", 6)]


@pytest.mark.parametrize("cuts", [[5], [1, 1, 1, 1, 1], [2, 3]])
def test_first_match_with_ttl_however_batches_are_cut(spark, folder, cuts):
    """By event time: hourly matches and a ttl of half an hour give all of them but the one in between."""
    feed = Feed(spark, folder, lambda s: stateful.first_match(s, "key", F.col("ok"), "id", ttl="30m"))
    items = [(1, "a", 0, True), (2, "a", 60, True), (3, "a", 80, True), (4, "a", 120, True), (5, "a", 150, True)]
    with _rocksdb(spark):
        for n in cuts:
            feed.run(items[:n])
            items = items[n:]
    assert feed.result("id") == [(1,), (2,), (4,), (5,)]


def test_keyed_sink_holds_one_row_per_key_after_reruns(spark, folder):
    source, sink = folder("source"), folder("sink")
    schema = rows(spark, []).schema
    for part in ([(1, "a", 0, True), (2, "b", 1, True)], [(3, "a", 5, True), (4, "c", 6, True)]):
        rows(spark, part).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        sinks.run_available(logs.stream_files(spark, source, schema, max_files=1), folder("checkpoint"),
                            sinks.idempotent_sink(sink, ["key"], ["ts"], buckets=3))
    assert sorted((r.key, r.id) for r in sinks.keyed_table(spark, sink).collect()) == [("a", 3), ("b", 2), ("c", 4)]


def test_first_match_is_forgotten_after_the_ttl(spark, folder):
    feed = Feed(spark, folder, lambda s: stateful.first_match(
        s, "key", F.col("ok"), "id", ttl="30m", watermark="0 seconds"))
    with _rocksdb(spark):
        feed.run([(1, "a", 0, True)])
        feed.run([(2, "a", 10, True), (3, "b", 100, True)])
        feed.run([(4, "a", 101, True)])
    assert feed.result("key", "id") == [("a", 1), ("a", 4), ("b", 3)]


def test_enrichment_of_a_table_too_large_to_broadcast(spark, folder):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "key string, grade int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    results = []
    for limit in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            feed = Feed(spark, folder, lambda s: stateful.enrich(s, table, "key", salts=3))
            feed.run([(i, k, i, True) for i, k in enumerate("aaab")] + [(9, "z", 0, True)])
            results.append(feed.result("id", "grade"))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert results[0] == results[1] == [(0, 1), (1, 1), (2, 1), (3, 2), (9, None)]


def test_replay_refuses_a_used_checkpoint(spark, folder):
    feed = Feed(spark, folder, lambda s: s)
    feed.run([(1, "a", 0, True)])
    stream = logs.stream_files(spark, feed.source, rows(spark, []).schema)
    with pytest.raises(ValueError, match="new checkpoint"):
        sinks.replay(stream, feed.checkpoint, sinks.idempotent_sink(folder("x")))


def test_restart_reads_only_what_is_new(spark, folder):
    feed = Feed(spark, folder, lambda s: s.select("id"))
    feed.run([(1, "a", 0, True)])
    feed.run([(2, "a", 0, True)])
    found = {r["batch_id"]: r["id"] for r in spark.read.parquet(feed.sink).collect()}
    assert found == {0: 1, 1: 2}


MALFORMED = ['{"k":1}garbage', '{"k":1} {"k":2}', '{"k":1},{"k":2}', '{"k":1}],[{"k":2}', '{"k":1}},{"x":{', "[1]", "5"]
LOG = "partition int, offset long, key string, value string, timestamp timestamp_ntz"


def record(partition, offset, key="k", value="{}", minute=0):
    return partition, offset, key, value, T0 + timedelta(minutes=minute)


def test_dead_letters_name_their_error(spark):
    log = spark.createDataFrame(
        [record(0, 0, value='{"k": 1, "more": 2}'), record(0, 1, value="{"), record(0, 2, value=None),
         record(1, 0, value='{"k": "x"}'), record(1, 1, value="{}"), record(2, 0, value=" "),
         *[record(3, i, value=v) for i, v in enumerate(MALFORMED)]], LOG)
    good, dead = sinks.split_dead_letters(log, "k int")
    assert sorted((r.partition, r.offset, r.k) for r in good.collect()) == [(0, 0, 1), (1, 1, None)]
    assert sorted((r.partition, r.offset, r.error_class, r.payload) for r in dead.collect()) == [
        (0, 1, "malformed_json", "{"), (0, 2, "missing_payload", None), (1, 0, "wrong_type", '{"k": "x"}'),
        (2, 0, "missing_payload", " "), *[(3, i, "malformed_json", v) for i, v in enumerate(MALFORMED)]]
    assert good.count() + dead.count() == log.count()


def test_dead_letters_are_written_once(spark, folder):
    log = spark.createDataFrame([record(0, i, value=v) for i, v in enumerate(['{"k": 5}', "{", "[1]"])], LOG)
    source, letters = folder("source"), folder("letters")
    log.coalesce(1).write.parquet(source)
    sinks.run_available(logs.stream_files(spark, source, log.schema), folder("checkpoint"),
                        sinks.dead_letter_sink("k int", letters))
    good, dead = sinks.stored_letters(spark, letters, "k int")
    assert [(r.offset, r.k) for r in good.collect()] == [(0, 5)]
    assert sorted((r.offset, r.payload) for r in dead.collect()) == [(1, "{"), (2, "[1]")]


def test_latest_by_key_with_deletes(spark):
    log = spark.createDataFrame(
        [record(0, 0, "a", "1"), record(0, 1, "a", "2"), record(1, 5, "b", "1"), record(1, 6, "b", None)], LOG)
    last = sinks.latest_by_key(log, "key", ["timestamp", "partition", "offset"], F.col("value").isNull())
    assert [(r.key, r.value) for r in last.collect()] == [("a", "2")]


def test_lag_of_a_trimmed_log(spark):
    log = spark.createDataFrame([record(0, o) for o in range(100, 110)] + [record(1, 0)], LOG)
    commits = spark.createDataFrame([("g", 0, 107), ("h", 1, 1)], "group string, partition int, offset long")
    lag = {(r.group, r.partition): r.lag for r in logs.consumer_lag(log, commits).collect()}
    assert lag == {("g", 0): 3, ("g", 1): 1, ("h", 0): 10, ("h", 1): 0}
    assert {r.group: r.lag for r in logs.group_lag(logs.consumer_lag(log, commits)).collect()} == {"g": 4, "h": 10}


def test_order_is_checked_across_slices(spark, monkeypatch):
    monkeypatch.setattr(logs, "_SLICE_OFFSETS", 4)
    minutes = [0, 1, 5, 4, 3, 9, 10, 11, 2, 12]
    log = spark.createDataFrame([record(0, i, minute=m) for i, m in enumerate(minutes)], LOG)
    row = logs.order_check(log).first()
    assert (row["records"], row["out_of_order"]) == (10, sum(b < a for a, b in zip(minutes, minutes[1:])))


def test_hot_keys_are_marked(spark):
    log = spark.createDataFrame([record(0, i, "hot" if i < 8 else f"k{i}") for i in range(10)], LOG)
    found = {r.key: (r.records, r.hot) for r in logs.key_skew(log, 0.5).collect()}
    assert found["hot"] == (8, True) and found["k9"] == (1, False)


def test_start_positions(spark, folder):
    path = folder("log")
    log = spark.createDataFrame([record(p, o) for p in (0, 1) for o in range(5)], LOG)
    log.write.parquet(path)
    def read(start):
        sink = folder("sink")
        checkpoint = folder("checkpoint")
        stream = logs.read_log(spark, path, log.schema, start, checkpoint=checkpoint).select("partition", "offset")
        sinks.run_available(stream, checkpoint, sinks.idempotent_sink(sink))
        return sorted(tuple(r) for r in sinks.appended(spark, sink).collect())
    assert len(read("earliest")) == 10
    assert read("latest") == []
    assert read({0: 3}) == [(0, 4)] + [(1, o) for o in range(5)]


def test_latest_reads_what_comes_between_runs(spark, folder):
    path, checkpoint, sink = folder("log"), folder("checkpoint"), folder("sink")
    spark.createDataFrame([record(0, 0)], LOG).write.parquet(path)

    def run():
        stream = logs.read_log(spark, path, spark.read.parquet(path).schema, "latest", checkpoint=checkpoint)
        sinks.run_available(stream.select("partition", "offset"), checkpoint, sinks.idempotent_sink(sink))

    run()
    for offset in (1, 2):
        spark.createDataFrame([record(0, offset)], LOG).write.mode("append").parquet(path)
        run()
    assert sorted(tuple(r) for r in sinks.appended(spark, sink).collect()) == [(0, 1), (0, 2)]
    with pytest.raises(ValueError, match="checkpoint"):
        logs.read_log(spark, path, spark.read.parquet(path).schema, "latest")


def test_unmatched_records_are_handed_on_once(spark, folder):
    """A left join of streams over several batches: matches at once, the rest when the watermark has passed them."""
    def job(stream):
        asks = stream.filter("ok").select("id", "key", "ts")
        answers = stream.filter("not ok").select(F.col("id").alias("answer"), "key", F.col("ts").alias("answer_ts"))
        return stateful.enrich_moving(asks, answers, "key", "ts", "answer_ts", "10m", watermark="30 minutes", how="left").select("id", "answer")

    feed = Feed(spark, folder, job)
    feed.run([(1, "a", 0, True), (2, "b", 1, True), (3, "a", 5, False), (4, None, 2, True)])
    feed.run([(5, "b", 14, False), (6, "a", 20, True), (7, "a", 21, True), (8, "a", 29, False)])
    key = lambda rows: sorted(rows, key=str)
    assert key(feed.result_unordered("id", "answer")) == key([(1, 3), (6, 8), (7, 8)])
    feed.run([(9, "z", 500, True), (10, "y", 500, False)])
    feed.run([(11, "z", 2000, True), (12, "y", 2000, False)])
    done = [(1, 3), (2, None), (4, None), (6, 8), (7, 8), (9, None)]
    assert key(feed.result_unordered("id", "answer")) == key(done)
    feed.run([(13, "x", 2001, False)])
    assert key(feed.result_unordered("id", "answer")) == key(done)
    with pytest.raises(ValueError, match="right"):
        stateful.enrich_moving(None, None, "key", "ts", "ts", "1m", how="right")


def test_a_part_of_the_events_is_a_batch(spark, folder, monkeypatch):
    """However many files and tasks the events are read from, and as how many files a part is written."""
    sf_dir = folder("tables")
    events = spark.range(600).select(
        F.col("id").alias("event_id"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 2).alias("user_id"), F.when(F.col("id") % 3 == 0, "purchase").otherwise("click").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    events.repartition(24).write.parquet(f"{sf_dir}/events.parquet")
    near = {(p, c) for p in range(0, 600, 3) for c in range(p - 10, p + 11, 2) if 0 <= c < 600 and c % 3}
    for rows_a_file in (streams._FILE_ROWS, 50):
        monkeypatch.setattr(streams, "_FILE_ROWS", rows_a_file)
        query = sinks.run_available(streams._event_stream(spark, sf_dir), folder("checkpoint"), sinks.idempotent_sink(folder("sink")))
        assert [p.numInputRows for p in query.recentProgress] == [200, 200, 200]
        for job in (streams.stream_enrich_moving, streams.stream_enrich_outer):
            found = [tuple(r) for r in job(spark, sf_dir).collect()]
            assert len(found) == len(near) and set(found) == near


def test_a_moving_record_is_kept_twice_at_most(spark, folder):
    """And meets all that are near it, at the very bounds too."""
    def job(stream):
        asks = stream.filter("ok").select("id", "key", "ts")
        answers = stream.filter("not ok").select(F.col("id").alias("answer"), "key", F.col("ts").alias("answer_ts"))
        return stateful.enrich_moving(asks, answers, "key", "ts", "answer_ts", "10m", watermark="1 day").select("id", "answer")

    feed = Feed(spark, folder, job)
    asks = [(n, "a", n * 0.5, True) for n in range(120)]
    answers = [(1000 + n, "a", n * 0.7 + 1e-7 * (n % 3), False) for n in range(90)]
    query = feed.run(asks + answers)
    us = lambda minutes: timedelta(minutes=minutes)
    near = [(a[0], b[0]) for a in asks for b in answers if abs(us(a[2]) - us(b[2])) <= us(10)]
    assert feed.result("id", "answer") == sorted(near)
    state = query.recentProgress[0].stateOperators[0]
    assert len(asks) + len(answers) < state.numRowsTotal <= len(asks) + 2 * len(answers)


def test_progress_of_more_than_a_hundred_batches(spark, folder):
    source, path = folder("source"), folder("progress")
    spark.range(110).repartition(110, "id").write.option("maxRecordsPerFile", 1).parquet(source)
    stream = logs.stream_files(spark, source, spark.range(0).schema, max_files=1)
    with audit.progress_log(spark, path) as listener:
        query = sinks.run_available(stream, folder("checkpoint"), lambda batch, number: batch.write.format("noop").mode("overwrite").save())
        listener.settle(query)
    rows = audit.progress(spark, path).collect()
    assert len({r["batch_id"] for r in rows}) == len(rows) > 100 and sum(r["input_rows"] for r in rows) == 110
    assert len(query.recentProgress) <= 100
    assert audit.progress(spark, folder("none")).count() == 0


def test_state_is_audited_against_the_last_batch(spark, folder):
    feed = Feed(spark, folder, lambda s: stateful.windowed_counts(s, "5 minutes", ["key"], watermark="10 minutes"), "update")
    feed.run([(1, "a", 0, True), (2, "a", 60, True), (3, "b", 61, True)])
    feed.run([(4, "a", 62, True)])
    row, = audit.state_audit(spark, feed.checkpoint).collect()
    assert row["operator"] == "stateStoreSave" and row["agrees"] and row["partitions"] == 4 and row["committed_batch"] == audit.committed_batch(spark, feed.checkpoint)
    held = audit.state_rows(spark, feed.checkpoint)
    assert sorted((r["key"], r["count"]) for r in held.collect()) == [("a", 2), ("b", 1)]
    # a checkpoint whose commits run ahead of its state is found
    files.write_text(spark, f"{feed.checkpoint}/commits/99", "v1\n{}")
    assert not audit.state_audit(spark, feed.checkpoint).first()["agrees"]


def test_delta_sink_writes_no_more_than_a_batch(spark, folder):
    path = folder("deltas")
    write = sinks.delta_sink(path, ["key"], ["id"])
    batch = lambda *items: spark.createDataFrame(items, "key string, id long, v string")
    key = lambda: sorted(map(tuple, sinks.delta_table(spark, path).collect()), key=str)
    write(batch(("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z"), (None, 1, "n")), 0)
    before = files.subfolders(spark, f"{path}/parts")
    write(batch(("a", 2, "old"), ("b", 1, "zz"), ("c", 1, "new")), 1)
    assert set(before) < set(files.subfolders(spark, f"{path}/parts"))
    expected = sorted([("a", 3, "y"), ("b", 1, "zz"), ("c", 1, "new"), (None, 1, "n")], key=str)
    assert key() == expected
    write(batch(("a", 1, "x"), ("b", 1, "z")), 0)
    sinks.fold_deltas(spark, path)
    assert key() == expected and len(files.subfolders(spark, f"{path}/parts")) == 1
    with pytest.raises(ValueError, match="no table"):
        sinks.delta_table(spark, folder("none"))


def test_delta_sinks_of_two_writers(spark, folder, monkeypatch):
    """A writer that lost its version to another one adds its part to the next."""
    path = folder("deltas")
    write = sinks.delta_sink(path, ["key"], ["id"])
    batch = lambda k: spark.createDataFrame([(k, 1)], "key string, id long")
    write(batch("a"), 0)
    stale, live, calls = sinks._live(spark, path), sinks._live, []
    write(batch("b"), 0)
    monkeypatch.setattr(sinks, "_live", lambda *args: calls.append(1) or (stale if len(calls) == 1 else live(*args)))
    write(batch("c"), 0)
    assert sorted(r["key"] for r in sinks.delta_table(spark, path).collect()) == ["a", "b", "c"] and len(calls) >= 2
