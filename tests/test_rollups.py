"""Rollups by signed changes: the sums of what is left, each batch once, and nothing read but changes."""

import random
from datetime import datetime, timedelta

import pytest

from tallyloom.sources import files, rollups, versions

T0 = datetime(2024, 1, 1)
SCHEMA = "id int, ts timestamp_ntz, k string, v double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if m is None else T0 + timedelta(minutes=m), k, v) for i, m, k, v in rows], SCHEMA)


def expected(rows):
    groups = {}
    for _, m, k, v in rows:
        if m is not None:
            at = T0 + timedelta(hours=m // 60)
            groups.setdefault((at.date(), at, k), []).append(v)
    out = []
    for key, values in groups.items():
        known = [v for v in values if v is not None and v == v]
        out.append((*key, len(values), round(sum(known), 6), round(sum(known) / len(known), 6) if known else None))
    return sorted(out, key=str)


def stored(spark, path):
    rows = rollups.read_rollup(spark, path).collect()
    return sorted(((r["day"], r["bucket"], r["k"], r["rows"], round(r["total"] or 0, 6),
                    None if r["mean"] is None else round(r["mean"], 6)) for r in rows), key=str)


def test_inserts_updates_and_deletes_leave_the_sums_of_what_is_left(spark, folder):
    random.seed(2)
    path, live, batches = folder("rollup"), {}, 0
    for step in range(5):
        fresh = {i: (i, random.choice([None, *range(0, 5000, 37)]), random.choice("abc"),
                     random.choice([None, float("nan"), 0.1, 0.2, 0.3, 1e9])) for i in range(100 * step, 100 * step + 60)}
        old = random.sample(sorted(live), min(len(live), 40))
        updated = {i: (i, *live[i][1:3], 7.77) for i in old[:20]}
        signed = rollups.changes(frame(spark, [*fresh.values(), *updated.values()]), frame(spark, [live[i] for i in old]))
        assert rollups.apply_changes(signed, path, ["k"], "v", f"b{step}")
        assert not rollups.apply_changes(signed, path, ["k"], "v", f"b{step}")
        live = {**{i: r for i, r in live.items() if i not in old}, **updated, **fresh}
        if step in (1, 3):
            rollups.fold(spark, path)
        assert stored(spark, path) == expected(live.values())
    signed = rollups.changes(deleted=frame(spark, list(live.values())))
    rollups.apply_changes(signed, path, ["k"], "v", "all gone")
    assert stored(spark, path) == []


def test_only_changes_are_read(spark, folder):
    raw, changed, path = folder("raw"), folder("changed"), folder("rollup")
    frame(spark, [(i, i, "a", 1.0) for i in range(500)]).write.parquet(raw)
    frame(spark, [(900, 3, "a", 5.0)]).write.parquet(changed)
    rollups.apply_changes(rollups.changes(spark.read.parquet(raw)), path, ["k"], "v", "1")
    files.remove(spark, raw)
    rollups.apply_changes(rollups.changes(spark.read.parquet(changed)), path, ["k"], "v", "2")
    assert sum(r[3] for r in stored(spark, path)) == 501
    plan = rollups.read_rollup(spark, path).filter("day = DATE '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(day" in plan


def test_of_two_writers_the_slower_adds_nothing(spark, folder, monkeypatch):
    path = folder("rollup")
    one = rollups.changes(frame(spark, [(1, 1, "a", 1.0)]))
    rollups.apply_changes(one, path, ["k"], "v", "1")
    before = rollups._state(spark, path)
    rollups.apply_changes(one, path, ["k"], "v", "2")
    monkeypatch.setattr(rollups, "_state", lambda *_: before)
    with pytest.raises(versions.Conflict):
        rollups.apply_changes(one, path, ["k"], "v", "3")
    monkeypatch.undo()
    assert [r[3] for r in stored(spark, path)] == [2] and len(files.subfolders(spark, f"{path}/parts")) == 2


def test_a_rollup_of_nothing(spark, folder):
    path = folder("rollup")
    with pytest.raises(ValueError, match="no rollup"):
        rollups.read_rollup(spark, path)
    rollups.apply_changes(rollups.changes(frame(spark, [])), path, ["k"], "v", "1")
    assert stored(spark, path) == []
    rollups.fold(spark, path)
    assert stored(spark, path) == []
