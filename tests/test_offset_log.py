"""The log that is read by offsets: what is planned, what is opened, and what a restart sees."""

from datetime import datetime, timedelta

import pytest

from tallyloom.sources import files, remote
from tallyloom.streaming import offset_log, sinks

T0 = datetime(2024, 1, 1)


def records(spark, spans):
    """Records of (partition, first offset, behind the last)."""
    return spark.createDataFrame(
        [(p, o, f"k{o}", None if o % 5 == 0 else f"v{p}-{o}", T0 + timedelta(seconds=o)) for p, a, b in spans for o in range(a, b)],
        "partition int, offset long, key string, value string, timestamp timestamp")


def run(spark, log, folder, start, checkpoint=None, sink=None):
    sink, checkpoint = sink or folder("sink"), checkpoint or folder("checkpoint")
    sinks.run_available(offset_log.read(spark, log, start, checkpoint), checkpoint, sinks.idempotent_sink(sink))
    if not files.exists(spark, sink):
        return []
    rows = sinks.appended(spark, sink).collect()
    assert all(r["key"] == f"k{r['offset']}" and r["timestamp"] == T0 + timedelta(seconds=r["offset"]) for r in rows)
    assert all(r["value"] == (None if r["offset"] % 5 == 0 else f"v{r['partition']}-{r['offset']}") for r in rows)
    return sorted((r["partition"], r["offset"]) for r in rows)


def spread(*spans):
    return sorted((p, o) for p, a, b in spans for o in range(a, b))


def test_log_is_read_from_any_position(spark, folder):
    log = folder("log")
    assert offset_log.append(records(spark, [(0, 0, 30), (1, 0, 5)]), log) == {0: 30, 1: 5}
    assert offset_log.append(records(spark, [(0, 30, 41), (7, 0, 2)]), log) == offset_log.ends(spark, log) == {0: 41, 1: 5, 7: 2}
    assert run(spark, log, folder, "earliest") == spread((0, 0, 41), (1, 0, 5), (7, 0, 2))
    assert run(spark, log, folder, {0: 25, 1: 5}) == spread((0, 25, 41), (7, 0, 2))
    assert run(spark, log, folder, {0: 100, 1: 5, 7: 2}) == []
    assert run(spark, log, folder, "latest") == []


def test_old_files_are_not_opened(spark, folder):
    """The data of earlier appends is overwritten with noise; a reader behind them does not notice."""
    log = folder("log")
    offset_log.append(records(spark, [(0, 0, 50), (1, 0, 50)]), log)
    for folder_name in files.subfolders(spark, f"{log}/data"):
        for part in ("partition=0", "partition=1"):
            for name in files.file_names(spark, f"{log}/data/{folder_name}/{part}"):
                if name.endswith(".parquet"):
                    files.remove(spark, f"{log}/data/{folder_name}/{part}/{name}")
                    files.write_text(spark, f"{log}/data/{folder_name}/{part}/{name}", "noise")
    checkpoint, sink = folder("checkpoint"), folder("sink")
    assert run(spark, log, folder, "latest", checkpoint, sink) == []
    offset_log.append(records(spark, [(0, 50, 60), (1, 50, 51)]), log)
    assert run(spark, log, folder, "latest", checkpoint, sink) == spread((0, 50, 60), (1, 50, 51))
    assert run(spark, log, folder, {0: 55, 1: 50}) == spread((0, 55, 60), (1, 50, 51))
    with pytest.raises(Exception):
        run(spark, log, folder, "earliest")


def test_only_overlapping_files_are_planned(spark, folder):
    log = folder("log")
    for n in range(6):
        offset_log.append(records(spark, [(0, 10 * n, 10 * n + 10), (1, n, n + 1)]).coalesce(1), log)
    reader = offset_log.OffsetReader(remote.qualified(spark, log), {}, records(spark, []).schema)
    assert reader.latestOffset() == {"0": 60, "1": 6}
    spans = reader.partitions({"0": 45, "1": 6}, {"0": 52, "1": 6})
    assert [(s.partition, s.first, s.last) for s in sorted(spans, key=lambda s: s.first)] == [(0, 45, 50), (0, 50, 52)]
    # commits of the last two appends were read, and no others
    assert sorted(reader.seen) == [4, 5]
    reader.commit({"0": 60, "1": 6})
    assert reader.seen == {}


def test_latest_keeps_its_first_positions_over_restarts(spark, folder):
    log, checkpoint, sink = folder("log"), folder("checkpoint"), folder("sink")
    offset_log.append(records(spark, [(0, 0, 10)]), log)
    assert run(spark, log, folder, "latest", checkpoint, sink) == []
    offset_log.append(records(spark, [(0, 10, 12)]), log)
    offset_log.append(records(spark, [(3, 0, 2)]), log)
    assert run(spark, log, folder, "latest", checkpoint, sink) == spread((0, 10, 12), (3, 0, 2))
    assert run(spark, log, folder, "latest", checkpoint, sink) == spread((0, 10, 12), (3, 0, 2))
    offset_log.append(records(spark, [(0, 12, 13)]), log)
    assert run(spark, log, folder, "latest", checkpoint, sink) == spread((0, 10, 13), (3, 0, 2))
    with pytest.raises(ValueError, match="checkpoint"):
        offset_log.read(spark, log, "latest")


@pytest.mark.parametrize("spans", [[(0, 5, 9)], [(0, 11, 12)], [(0, 10, 12), (0, 11, 13)], [(0, 10, 11), (0, 12, 13)], [(2, 1, 2)]])
def test_appends_that_do_not_continue_the_log_are_refused(spark, folder, spans):
    log = folder("log")
    offset_log.append(records(spark, [(0, 0, 10)]), log)
    with pytest.raises(offset_log.LogConflict, match="goes on at"):
        offset_log.append(records(spark, spans), log)
    assert run(spark, log, folder, "earliest") == spread((0, 0, 10))


def test_of_two_writers_one_wins(spark, folder, monkeypatch):
    log = folder("log")
    offset_log.append(records(spark, [(0, 0, 3)]), log)
    last = offset_log._last_commit(spark, log)
    offset_log.append(records(spark, [(0, 3, 5)]), log)
    monkeypatch.setattr(offset_log, "_last_commit", lambda *_: last)
    with pytest.raises(offset_log.LogConflict, match="another writer"):
        offset_log.append(records(spark, [(0, 3, 9)]), log)
    monkeypatch.undo()
    assert run(spark, log, folder, "earliest") == spread((0, 0, 5))


def test_an_empty_append_leaves_the_log(spark, folder):
    log = folder("log")
    with pytest.raises(ValueError, match="no log"):
        offset_log.read(spark, log)
    offset_log.append(records(spark, [(0, 0, 3)]), log)
    assert offset_log.append(records(spark, []), log) == {0: 3}
    assert files.file_names(spark, f"{log}/_commits") >= {f"{0:020d}.json"} and offset_log.ends(spark, log) == {0: 3}


def test_addresses_that_workers_cannot_open_are_refused(spark):
    assert remote.qualified(spark, "/tmp/x") == "file:///tmp/x"
    assert remote.store("file:///tmp/x")[1] == "/tmp/x"
    spark.conf.set("fs.viewfs.mounttable.none.link./in", "file:///tmp")
    with pytest.raises(Exception):
        remote.qualified(spark, "viewfs://none/in")
