"""Snapshot tables, the outbox and the figures kept up by changes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from revlens.streaming import keyed, outbox, refresh, runner, snapshots

SCHEMA = "k string, at long, v long"


def write(spark, path, batch_id, rows, **kw):
    return snapshots.commit(spark.createDataFrame(rows, SCHEMA), path, batch_id, ["k"], ["at"], **kw)


def rows_of(df):
    return sorted((r.k, r.at, r.v) for r in df.collect())


def test_last_write_wins_over_many_batches(spark, tmp_path):
    """n micro-batches leave O(log n) parts, and the last write of each key."""
    r, path, want = random.Random(1), f"{tmp_path}/t", {}
    for batch in range(30):
        rows = [(f"k{i}", r.randrange(100), batch * 100 + i) for i in r.sample(range(25), 4)]
        write(spark, path, batch, rows, fan=3)
        for k, at, v in rows:
            if k not in want or (at, batch) >= want[k][0]:
                want[k] = ((at, batch), v)
        assert len(snapshots.manifest(spark, path)["parts"]) <= 10
    assert rows_of(snapshots.read(spark, path)) == sorted((k, a[0], v) for k, (a, v) in want.items())


def test_reader_keeps_its_version(spark, tmp_path):
    """A reader that has begun sees its version whole, through writes and merges."""
    path = f"{tmp_path}/t"
    version = write(spark, path, 0, [("a", 1, 1), ("b", 1, 2)])
    begun = snapshots.read(spark, path)
    for batch in range(1, 12):
        write(spark, path, batch, [("a", batch + 1, batch * 10), (f"n{batch}", 0, 0)], fan=2)
    assert rows_of(begun) == rows_of(snapshots.read(spark, path, version)) == [("a", 1, 1), ("b", 1, 2)]
    assert len(rows_of(snapshots.read(spark, path))) == 13


def test_part_without_manifest_is_not_seen(spark, tmp_path):
    """A writer that dies before its manifest leaves the version before."""
    path = f"{tmp_path}/t"
    write(spark, path, 0, [("a", 1, 1)])
    spark.createDataFrame([("x", 1, 1)], SCHEMA).write.parquet(f"{path}/data/1-dead")
    assert rows_of(snapshots.read(spark, path)) == [("a", 1, 1)]


def test_replay_replaces(spark, tmp_path):
    path = f"{tmp_path}/t"
    write(spark, path, 0, [("a", 1, 1)])
    write(spark, path, 1, [("a", 2, 2), ("b", 1, 1)])
    write(spark, path, 1, [("a", 2, 3)])
    assert rows_of(snapshots.read(spark, path)) == [("a", 2, 3)]
    write(spark, path, 2, [], fan=2)
    write(spark, path, 3, [("c", 1, 1)], fan=2)
    with pytest.raises(ValueError):
        write(spark, path, 0, [("a", 9, 9)])
    write(spark, path, 3, [("d", 1, 1)], replace=True)
    assert rows_of(snapshots.read(spark, path)) == [("d", 1, 1)]


def test_sums_and_vacuum(spark, tmp_path):
    path = f"{tmp_path}/t"
    for batch in range(9):
        df = spark.createDataFrame([("x", 1), ("y", -batch)], "k string, v long")
        snapshots.commit(df, path, batch, ["k"], merge="sum", fan=3)
    assert {r.k: r.v for r in snapshots.read(spark, path).collect()} == {"x": 9, "y": -36}
    snapshots.vacuum(spark, path, keep=1)
    assert len(snapshots.versions(spark, path)) == 1
    assert {r.k: r.v for r in snapshots.read(spark, path).collect()} == {"x": 9, "y": -36}


def test_second_writer_fails(spark, tmp_path):
    path = f"{tmp_path}/t"
    write(spark, path, 0, [("a", 1, 1)])
    now = snapshots.manifest(spark, path)
    with pytest.raises(RuntimeError):
        snapshots._publish(spark, path, now)


def test_key_filters_reach_the_parts(spark, tmp_path):
    path = f"{tmp_path}/t"
    write(spark, path, 0, [("a", 1, 1), ("b", 1, 2)])
    plan = snapshots.read(spark, path).where("k = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan


def test_outbox_publishes_once(spark, tmp_path):
    path, schema = f"{tmp_path}/complete", "review_id string, body string, event_type string, ts timestamp"
    t = dt.datetime(2024, 1, 1)
    one, two = ("a", "{}", "review.complete", t), ("b", "{1}", "review.complete", t)
    for batch, rows in ((0, [one, one]), (0, [one]), (1, [one, two]), (2, [two]), (2, [two])):
        outbox.publish(spark.createDataFrame(rows, schema), path, batch)
    got = sorted((r.review_id, r.batch_id, r.event_type) for r in spark.read.parquet(path).collect())
    assert got == [("a", 0, "review.complete"), ("b", 1, "review.complete")]


def test_changes_take_back_what_they_replace(spark, tmp_path):
    """After each micro-batch the totals equal a recount of the last writes."""
    r, t = random.Random(4), dt.datetime(2024, 1, 1)
    writes = [("severity", f"f{r.randrange(20)}", r.choice(["critical", "warning", "info"]), t + dt.timedelta(days=r.randrange(9)), i) for i in range(120)]
    schema = "metric string, key string, value string, ts timestamp, tie long"
    seen = []

    def check(rows, batch_id):
        refresh.totals_micro_batches(str(tmp_path))(rows, batch_id)
        seen.extend(writes[batch_id * 40 : batch_id * 40 + 40])
        last = {}
        for w in sorted(seen, key=lambda w: (w[3], w[4])):
            last[w[1]] = w[2]
        want = {s: list(last.values()).count(s) for s in set(last.values())}
        got = {x.name: x.value for x in snapshots.read(spark, f"{tmp_path}/totals").where("value <> 0").collect()}
        assert got == want

    drops = [spark.createDataFrame(writes[i : i + 40], schema) for i in (0, 40, 80)]
    runner.replay(drops, "values-test", refresh.latest_values, sink=check, files=1)
    assert len(seen) == 120


def test_panes_equal_batch(spark, tmp_path):
    from revlens.operators.dashboard import function_metrics
    from revlens.sources.driver import derived

    inv = derived(spark, "/root/testdata/sf0.001", "invocations")
    runner.replay(runner.in_drops(inv, F.col("duration_ms"), 3), "panes-test", lambda s: s, sink=refresh.pane_micro_batches(str(tmp_path)))
    panes = snapshots.read(spark, f"{tmp_path}/panes")
    assert panes.groupBy("function", "pane").count().where("count > 1").count() == 0
    for now in ("2024-01-20 00:00:00", "2024-01-30 12:00:00"):
        got = {tuple(r) for r in refresh.pane_metrics(spark, panes, now).collect()}
        assert got == {tuple(r) for r in function_metrics(inv, now).collect()} and got


def test_fates_are_retracted(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("m", "q", t, 5, False), ("m", "q", t, 6, False), ("m", "q", t, 7, False), ("m", "q", t, 1, True)]
    schema = "message_id string, queue string, received_at timestamp, receive_seq long, succeeded boolean"
    drops = [spark.createDataFrame(rows[:3], schema), spark.createDataFrame(rows[3:], schema)]
    folder = runner.replay(drops, "fates-test", keyed.message_fates, files=1, idle_batches=False)
    got = [(r.version, r.change, r.route) for r in spark.read.parquet(f"{folder}/out").orderBy("version", F.desc("change")).collect()]
    assert got == [(0, 1, "dead"), (0, -1, "dead"), (1, 1, "acked")]
