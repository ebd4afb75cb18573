"""State calls per bucket, inputs read once: what grows with the input stays a row's work."""

from __future__ import annotations

import datetime as dt
import json
import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F

from revlens.streaming import barrier, keyed, refresh


class FakeState:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def fed(processor, state, rows, ms=0):
    processor.init(state)
    return list(processor.handleInputRows((0,), iter(rows), Clock(ms)))


def test_fates_take_one_state_for_a_bucket():
    rows = [Row(message_id=f"m{i}", queue="q", __at=i, receive_seq=i, succeeded=False) for i in range(100)]
    state = FakeState()
    out = fed(keyed.Receives(3, None), state, rows)
    assert state.calls == 2 and len(out) == 100
    out = fed(keyed.Receives(3, None), state, rows[:10])
    assert state.calls == 4 and [r.change for r in out] == [-1, 1] * 10
    assert {(r.message_id, r.receives, r.version) for r in out if r.change == 1} == {(f"m{i}", 2, 1) for i in range(10)}


def test_forgotten_keys_leave_their_bucket():
    state, ttl = FakeState(), 1000
    def row(k, at):
        return Row(k=k, __at=at, __tie=0)

    first = keyed.FirstPerKey(["k"], "k", ttl)
    assert [r.kind for r in fed(first, state, [row("a", 5), row("b", 5)], 0)] == ["first", "first"]
    assert [r.kind for r in fed(first, state, [row("a", 6)], 900)] == ["duplicate"]  # renews a, not b
    assert [(r.k, r.kind) for r in fed(first, state, [row("a", 7), row("b", 7), row(None, 1)], 1500)] == [
        ("a", "duplicate"), ("b", "first"), (None, "first")]
    assert len(json.loads(state.value[0])) == 3


def test_latest_values_sum_the_changes_of_a_bucket():
    state = FakeState()
    def row(key, value, at):
        return Row(metric="severity", key=key, value=value, __at=at, __tie=0)

    out = fed(refresh.LatestValue(), state, [row(f"k{i}", "info", 1) for i in range(50)])
    assert state.calls == 2 and [(r.name, r.value) for r in out] == [("info", 50)]
    out = fed(refresh.LatestValue(), state, [row("k1", "critical", 2), row("k2", "critical", 0), row("k3", "info", 3)])
    assert sorted((r.name, r.value) for r in out) == [("critical", 1), ("info", -1)]


def test_one_bucket_gives_what_many_give(spark):
    from revlens.streaming import runner

    t = dt.datetime(2024, 1, 1)
    drops = [spark.createDataFrame([(f"k{i % 7}", t + dt.timedelta(seconds=(i * 5) % 11), i) for i in part], "k string, at timestamp, id long")
             for part in (range(20), range(20, 40))]
    got = []
    for buckets in (1, 1 << 15):
        folder = runner.replay(drops, "buckets-test", lambda s, n=buckets: keyed.first_per_key(s, "k", "at", F.col("id"), ttl_s=3600, buckets=n), files=1, idle_batches=False)
        got.append(sorted((r.id, r.k, r.kind) for r in spark.read.parquet(f"{folder}/out").collect()))
    assert got[0] == got[1] and len(got[0]) == 40


def test_rows_without_reviewer_end_above_the_watermark(spark):
    """They move the clock and never reach the processor."""
    stream = spark.readStream.schema("review_id string, agent string, ts timestamp").parquet(tempfile.mkdtemp(prefix="revlens-clock-"))
    plan = spark._jsparkSession.sessionState().optimizer().execute(barrier.barrier_stream(stream)._jdf.queryExecution().analyzed()).toString()
    lines = plan.split("\n")
    mark = next(i for i, line in enumerate(lines) if "EventTimeWatermark" in line)
    tests = [i for i, line in enumerate(lines) if "Filter" in line and "agent" in line]
    assert tests and max(tests) < mark


def test_landed_files_of_a_micro_batch_are_read_once(spark):
    """Every table of a review comes from one reading of its files."""
    from revlens.operators import admission as adm
    from revlens.plans.offline import no_sleep, offline_scorer_factory
    from revlens.sources import landed
    from revlens.streaming import pipeline, snapshots

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    file = {"filename": "a.py", "status": "added", "additions": 1, "deletions": 0, "patch": "@@ -0,0 +1 @@\n+x = 1"}
    rows = spark.createDataFrame([("r", i, json.dumps(file)) for i in range(3)], "review_id string, ordinal long, file_json string")
    values = {c: 5 if c in ("pr_number", "installation_id") else "x" for c in adm.EVENT_COLUMNS}
    schema = "review_id string, received_at timestamp, kind string, " + ", ".join(
        f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in values.items())
    events = spark.createDataFrame([(r, dt.datetime(2024, 1, 1), "first", *values.values()) for r in ("r", "no files")], schema)
    out = tempfile.mkdtemp(prefix="revlens-once-")

    def files(ev):
        return landed.pr_files(rows.join(ev.select("review_id"), "review_id").withColumn("file_json", counted("file_json")))

    pipeline.review_micro_batches(out, files, offline_scorer_factory, sleep=no_sleep)(events, 0)
    assert read.value == 3
    assert {r.pk for r in snapshots.read(spark, f"{out}/items").collect()} == {"REV#r"}


def test_chunk_counts_come_from_the_replies(spark):
    from revlens.plans.batch import review_batch
    from revlens.plans.offline import no_sleep, offline_scorer_factory

    rows = [(r, i, f"f{i}.py", "added", n, 0, "+x", None) for r, n, files in (("a", 300, 40), ("b", 1, 3)) for i in range(files)]
    rows.append(("generated", 0, "package-lock.json", "added", 5, 0, "+x", None))
    files = spark.createDataFrame(rows, "review_id string, ordinal long, filename string, status string, additions long, deletions long, patch string, previous_filename string")
    b = review_batch(files, offline_scorer_factory, sleep=no_sleep)
    want = {(r.review_id, r.n) for r in b.assigned.groupBy("review_id").agg(F.max("total_chunks").alias("n")).collect()}
    assert {(r.review_id, r.total_chunks) for r in b.chunk_counts.collect()} == want and len(want) == 2


def test_typed_events_admit_a_request_once(spark, monkeypatch):
    """Both texts of a request come from one reading of the requests."""
    from revlens.plans.q_ingest import q_typed_event_parse
    from revlens.streaming import quarantine

    plans, real = [], quarantine.typed_micro_batches

    def spied(out_dir, *rest):
        run = real(out_dir, *rest)

        def noted(rows, batch_id):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return run(rows, batch_id)

        return noted

    monkeypatch.setattr(quarantine, "typed_micro_batches", spied)
    q_typed_event_parse(spark, "/root/testdata/sf0.001")
    assert plans[0].count("Relation [") == 1
