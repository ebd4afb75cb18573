"""Quarantine: one pass, two tables, and a replay after a change of the model."""

from __future__ import annotations

import json

from revlens.streaming import quarantine, runner, snapshots

KEYS = ["id"]
OLD = [("name", "string", None), ("size", "bigint", 0)]
NEW = [("name", "string", "none"), ("size", "bigint", 0), ("tag", "string", "t")]  # a default where one was demanded
ROWS = [(1, json.dumps({"name": "a", "size": 3})), (2, json.dumps({"size": 4})), (3, json.dumps({"name": "c", "size": "x"})), (4, "nope"), (5, None)]


def test_rows_leave_quarantine_once(spark, tmp_path):
    out = str(tmp_path)
    first, second = (spark.createDataFrame(rows, "id long, text string") for rows in (ROWS[:2], ROWS[2:]))
    run = quarantine.typed_micro_batches(out, OLD, KEYS)
    runner.replay([first, second], "typed-test", lambda s: s, sink=run, files=1)
    assert [r["id"] for r in quarantine.events(spark, out).collect()] == [1]
    assert {r.id: r.n_violations for r in quarantine.held(spark, out).collect()} == {2: 1, 3: 1, 4: 1, 5: 1}
    assert quarantine.held(spark, out).where("id = 2").first().violations == "name"
    for _ in range(3):  # repeated replays change nothing more
        quarantine.replay(spark, out, NEW, KEYS)
        got = sorted((r["id"], r["name"], r["size"], r["tag"]) for r in quarantine.events(spark, out).collect())
        assert got == [(1, "a", 3, None), (2, "none", 4, "t")]
        assert {r.id for r in quarantine.held(spark, out).collect()} == {3, 4, 5}
    run(spark.createDataFrame([(9, ROWS[0][1])], "id long, text string"), 2)  # the stream goes on
    assert {r["id"] for r in quarantine.events(spark, out).collect()} == {1, 2, 9}


def test_replay_that_stopped_in_between(spark, tmp_path):
    """Events stored, messages not yet released: the next replay ends it, without doubles."""
    out = str(tmp_path)
    quarantine.typed_micro_batches(out, OLD, KEYS)(spark.createDataFrame(ROWS, "id long, text string"), 0)
    quarantine.replay(spark, out, NEW, KEYS)
    snapshots.commit(spark.createDataFrame([], "id long"), f"{out}/released", 1, KEYS, replace=True)
    assert 2 in {r.id for r in quarantine.held(spark, out).collect()}
    quarantine.replay(spark, out, NEW, KEYS)
    assert sorted(r["id"] for r in quarantine.events(spark, out).collect()) == [1, 2]
    assert {r.id for r in quarantine.held(spark, out).collect()} == {3, 4, 5}


def test_replay_of_a_batch_changes_nothing(spark, tmp_path):
    out, run = str(tmp_path), quarantine.typed_micro_batches(str(tmp_path), OLD, KEYS)
    df = spark.createDataFrame(ROWS, "id long, text string")
    run(df, 0)
    run(df, 0)
    assert [tuple(r) for r in quarantine.events(spark, out).collect()] == [(1, "a", 3)] and quarantine.held(spark, out).count() == 4
