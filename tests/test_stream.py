"""Stream = batch: the completion barrier over a replayed landing folder."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from revlens.streaming import runner, sinks
from revlens.streaming.barrier import barrier_batch, barrier_stream, decisions


def envelope_schema():
    from pyspark.sql import types as T

    from revlens.sources import landed

    return T.StructType([*landed.ENVELOPE_SCHEMA.fields, T.StructField("received_at", T.TimestampType())])


def test_barrier_complete_and_timeout(spark):
    t = dt.datetime(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    rows = [
        # complete: 4 reviewers within 15 s -> fires at the 4th (t+9)
        ("full", "security", t), ("full", "style", t + 3 * s), ("full", "performance", t + 5 * s), ("full", "test", t + 9 * s),
        # incomplete: 3 reviewers in time, the 4th too late -> fires at t+15 with 3
        ("slow", "security", t), ("slow", "style", t + 2 * s), ("slow", "test", t + 4 * s), ("slow", "performance", t + 40 * s),
        # a far later event moves the watermark past all deadlines
        ("other", None, t + 3600 * s),
    ]
    df = spark.createDataFrame(rows, "review_id string, agent string, ts timestamp")
    batch = {r.review_id: (r.seen_agents, r.complete, r.fired_at) for r in barrier_batch(df).collect()}
    assert batch["full"] == (4, True, t + 9 * s)
    assert batch["slow"] == (3, False, t + 15 * s)

    land = tempfile.mkdtemp(prefix="revlens-land-")
    df.write.mode("overwrite").parquet(os.path.join(land, "part"))
    stream = spark.readStream.schema("review_id string, agent string, ts timestamp").parquet(os.path.join(land, "part"))
    folder = runner.run(barrier_stream(stream), "barrier-test")
    fired = spark.read.parquet(f"{folder}/out").filter("kind = 'fired'")
    got = {r.review_id: (r.seen_agents, r.complete, r.fired_at) for r in fired.collect()}
    assert len(got) == 2  # the last review's time is not over
    assert got["full"] == batch["full"]
    assert got["slow"] == batch["slow"]


def test_admission_stream_dedupes_redeliveries(spark):
    import json

    from revlens.sources import landed
    from revlens.streaming.pipeline import admission_stream

    payload = {"action": "opened", "pull_request": {"number": 5, "head": {"sha": "s1"}}, "repository": {"full_name": "o/r"}}
    other = {**payload, "pull_request": {"number": 6, "head": {"sha": "s2"}}}
    t = dt.datetime(2024, 1, 1)
    rows = [
        ({"X-GitHub-Event": "pull_request"}, json.dumps(payload), False, t),
        ({"X-GitHub-Event": "pull_request"}, json.dumps({**payload, "action": "synchronize"}), False, t + dt.timedelta(seconds=5)),
        ({"X-GitHub-Event": "pull_request"}, json.dumps(other), False, t),
        ({"X-GitHub-Event": "push"}, json.dumps(payload), False, t),
    ]
    schema = envelope_schema()
    land = tempfile.mkdtemp(prefix="revlens-env-")
    spark.createDataFrame(rows, schema).write.mode("overwrite").json(os.path.join(land, "in"))
    stream = spark.readStream.schema(schema).json(os.path.join(land, "in"))
    folder = runner.run(admission_stream(stream, secret=""), "admission-test", idle_batches=False)
    got = sorted((r.pr_number, r.kind, r.action) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(5, "duplicate", "synchronize"), (5, "first", "opened"), (6, "first", "opened")]


def test_dead_letter_routing_stream(spark):
    """Fates add up over micro-batches, receives out of order; what is dead is there once."""
    from revlens.streaming import keyed, snapshots
    from revlens.streaming.pipeline import dead_letter_micro_batches

    t = dt.datetime(2024, 1, 1)
    rows = [("a", "parse-queue", t, 1, True), ("b", "test-queue", t, 2, False), ("b", "test-queue", t, 3, False),
            ("b", "test-queue", t, 4, False), ("c", "style-queue", t, 5, False), ("d", "q", t, 6, True), ("d", "q", t, 7, False)]
    schema = "message_id string, queue string, received_at timestamp, receive_seq long, succeeded boolean"
    want = {"a": "acked", "b": "dead", "c": "retry", "d": "acked"}
    for name, order in (("one", [[0, 1, 2, 3, 4, 5, 6]]), ("many", [[1], [4, 6], [3], [0], [2, 5]])):
        out = tempfile.mkdtemp(prefix="revlens-dlq-")
        drops = [spark.createDataFrame([rows[i] for i in part], schema) for part in order]
        runner.replay(drops, f"dlq-{name}", keyed.message_fates, sink=dead_letter_micro_batches(out), files=1, idle_batches=False)
        assert {r.message_id: r.route for r in snapshots.read(spark, f"{out}/routes").collect()} == want
        assert [r.message_id for r in spark.read.parquet(f"{out}/dead_letters").collect()] == ["b"]


def test_timeout_raises_instead_of_partial_output(spark):
    import time

    import pytest

    land = tempfile.mkdtemp(prefix="revlens-slow-")
    for i in range(4):
        spark.range(i, i + 1).coalesce(1).write.parquet(os.path.join(land, f"in/{i}"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(os.path.join(land, "in/*"))
    with pytest.raises(TimeoutError):
        runner.run(stream, "slow-test", sink=lambda df, batch_id: time.sleep(3), timeout_s=2)


def test_replay_that_shrinks_leaves_nothing(spark):
    out = tempfile.mkdtemp(prefix="revlens-shrink-")
    sinks.write_batch(spark.range(5), f"{out}/t", 3)
    sinks.write_batch(spark.range(0).where("false"), f"{out}/t", 3)
    sinks.write_batch(spark.range(2), f"{out}/t", 4)
    assert spark.read.parquet(f"{out}/t").count() == 2


def test_latest_of_items_with_maps(spark):
    from revlens.sources.store import learning_items, upsert_latest

    t = dt.datetime(2024, 1, 1)
    rows = [("r1", "comment", t, 1), ("r1", "approve", t + dt.timedelta(hours=1), 2)]
    items = learning_items(spark.createDataFrame(rows, "review_id string, verdict string, write_ts timestamp, write_seq long"), keep=("write_ts", "write_seq"))
    assert [r.attrs["verdict"] for r in upsert_latest(items).collect()] == ["approve"]


def test_resumed_stream_does_not_duplicate(spark):
    """Restart on the same checkpoint: already committed batches are not
    written again, new files are picked up."""
    import uuid

    land = tempfile.mkdtemp(prefix="revlens-resume-")
    schema = "k string, v long"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.mode("append").parquet(land)
    name = f"resume-{uuid.uuid4().hex[:8]}"
    folder = runner.run(spark.readStream.schema(schema).parquet(land), name, resume=True)
    assert spark.read.parquet(f"{folder}/out").count() == 2
    spark.createDataFrame([("c", 3)], schema).write.mode("append").parquet(land)
    folder2 = runner.run(spark.readStream.schema(schema).parquet(land), name, resume=True)
    assert folder2 == folder
    assert sorted(r.k for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b", "c"]


def test_seen_agents_stream_matches_batch(spark):
    from revlens.operators.dashboard import seen_agents, seen_agents_stream
    from revlens.sources.driver import derived, derived_stream

    sf = "/root/testdata/sf0.001"
    folder = runner.run(seen_agents_stream(derived_stream(spark, sf, "findings_in")), "seen-test", output_mode="complete")
    got = {(r.review_id, r.seen_agents, r.complete) for r in spark.read.parquet(f"{folder}/out").collect()}
    want = {(r.review_id, r.seen_agents, r.complete) for r in seen_agents(derived(spark, sf, "findings_in")).collect()}
    assert got == want and got


def test_read_envelopes_stream(spark):
    import base64
    import json

    from revlens.sources import landed

    land = tempfile.mkdtemp(prefix="revlens-envjson-")
    body = json.dumps({"action": "opened"})
    rows = [
        {"headers": {"X-GitHub-Event": "pull_request"}, "body": body, "isBase64Encoded": False},
        {"headers": {"x-github-event": "push"}, "body": base64.b64encode(body.encode()).decode(), "isBase64Encoded": True},
    ]
    with open(os.path.join(land, "part-0.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows))
    stream = landed.webhook_envelopes(landed.read_envelopes(spark, land))
    out = stream.select(landed.header("x-github-event").alias("event"), "body_text")
    folder = runner.run(out, "envelopes-test")
    got = sorted((r.event, r.body_text) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("pull_request", body), ("push", body)]


def test_completion_event_rule(spark):
    """Reviewer completion events (zero findings included) complete the barrier."""
    t = dt.datetime(2024, 1, 1)
    rows = [("r", a, t + dt.timedelta(seconds=i)) for i, a in enumerate(["security", "performance", "style", "test"])]
    df = spark.createDataFrame(rows, "review_id string, agent string, ts timestamp")
    got = barrier_batch(df).first()
    assert (got.seen_agents, got.complete) == (4, True)


def barrier_replay(spark, batches, **kw):
    schema = "review_id string, agent string, ts timestamp"
    drops = [spark.createDataFrame(rows, schema) for rows in batches]
    folder = runner.replay(drops, "barrier-test", lambda s: barrier_stream(s, event_key=F.col("agent"), **kw), files=1)
    return spark.read.parquet(f"{folder}/out")


def test_barrier_over_many_micro_batches(spark):
    """Out of order, in many micro-batches: one `fired` row per review, late events as
    rows of their own, and decisions equal to the batch form."""
    t, s = dt.datetime(2024, 1, 1), dt.timedelta(seconds=1)
    batches = [
        [("r", "style", t + 9 * s), ("q", "test", t + 3 * s)],
        [("r", "security", t), ("q", "style", t + 1 * s)],  # earlier: moves t0 back
        [("r", "test", t + 20 * s), ("q", "security", t + 2 * s), ("q", "performance", t + 9 * s)],  # r: past its time
        [("x", None, t + 50 * s)],  # the watermark passes t + 40 s
        [("r", "performance", t + 45 * s), ("q", "test", t + 46 * s)],  # late: both have fired
        [("x", None, t + 300 * s)],
    ]
    rows = barrier_replay(spark, batches, watermark="10 seconds").collect()
    fired = sorted((r.review_id, r.seen_agents, r.complete, r.fired_at) for r in rows if r.kind == "fired")
    events = spark.createDataFrame([x for b in batches for x in b if x[1]], "review_id string, agent string, ts timestamp")
    want = sorted((r.review_id, r.seen_agents, r.complete, r.fired_at) for r in barrier_batch(events).collect())
    assert fired == want == [("q", 4, True, t + 9 * s), ("r", 2, False, t + 15 * s)]
    # r's timer runs after the rows of the micro-batch that moved the clock past it
    assert [(r.review_id, r.event_key) for r in rows if r.kind == "late"] == [("q", "test")]
    assert sorted((r.review_id, r.events) for r in rows if r.kind == "fired") == [("q", 4), ("r", 4)]


def test_review_behind_the_watermark_is_decided(spark):
    """A review whose events come hours after all others' fires all the same."""
    t, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    s = dt.timedelta(seconds=1)
    batches = [[("new", "test", t)], [("x", None, t + 2 * h)], [("old", "style", t - 5 * h)], [("old", "test", t - 5 * h + 3 * s)]]
    rows = barrier_replay(spark, batches, watermark="10 seconds")
    got = sorted((r.review_id, r.seen_agents, r.fired_at, r.version) for r in decisions(rows).collect())
    assert got == [("new", 1, t + 15 * s, 0), ("old", 2, t - 5 * h + 15 * s, 1)]
    assert [(r.review_id, r.kind) for r in rows.where("review_id = 'old'").orderBy("version").collect()] == [
        ("old", "late"), ("old", "fired"), ("old", "amended")]


def test_any_order_of_days_equals_batch(spark):
    """Random events dealt over micro-batches at random: decisions equal the batch form
    and every event is counted by its review's fired row or is a late row."""
    import random

    r = random.Random(11)
    t = dt.datetime(2024, 1, 1)
    agents = ["security", "performance", "style", "test"]
    events = [(f"r{i % 40}", r.choice(agents), t + dt.timedelta(days=i % 40, milliseconds=r.randrange(40_000))) for i in range(400)]
    batches = [[] for _ in range(4)]
    for e in events:
        r.choice(batches).append(e)
    batches.append([("x", None, t + dt.timedelta(days=90))])
    rows = barrier_replay(spark, batches, watermark="1 minute")
    schema = "review_id string, agent string, ts timestamp"
    want = {(x.review_id, x.seen_agents, x.complete, x.fired_at) for x in barrier_batch(spark.createDataFrame(events, schema)).collect()}
    assert {(x.review_id, x.seen_agents, x.complete, x.fired_at) for x in decisions(rows).collect()} == want
    assert rows.where("kind = 'fired'").count() == 40
    assert rows.where("kind <> 'amended'").agg(F.sum("events")).first()[0] == 400


def test_forgotten_review_is_not_decided_again(spark):
    """With a retention, state goes; events of a forgotten review are late rows."""
    t, d = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    batches = [[("r", a, t) for a in ("security", "performance", "style", "test")], [("x", None, t + 3 * d)], [("x", None, t + 4 * d)], [("r", "test", t)]]
    rows = barrier_replay(spark, batches, watermark="1 second", retention_s=86_400).collect()
    assert sorted((r.review_id, r.kind) for r in rows) == [("r", "fired"), ("r", "late")]


def test_barrier_sinks_keep_late_findings(spark):
    from revlens.streaming.barrier import barrier_micro_batches

    t = dt.datetime(2024, 1, 1)
    out = tempfile.mkdtemp(prefix="revlens-late-")
    drops = [spark.createDataFrame(x, "review_id string, agent string, ts timestamp") for x in (
        [("r", a, t) for a in ("security", "performance", "style", "test")], [("r", "test", t + dt.timedelta(days=2))])]
    runner.replay(drops, "late-test", lambda s: barrier_stream(s, event_key=F.col("agent")), sink=barrier_micro_batches(out), files=1)
    assert spark.read.parquet(f"{out}/triggers").count() == 1
    assert [(r.review_id, r.agent, r.ts) for r in spark.read.parquet(f"{out}/late_findings").collect()] == [("r", "test", t + dt.timedelta(days=2))]


def test_slow_reviewer_misses_the_deadline(spark):
    """Review events carry their reviewer's finish time, so a slow one leaves the barrier
    incomplete."""
    t = dt.datetime(2024, 1, 1)
    rows = [("r", a, t + dt.timedelta(milliseconds=ms)) for a, ms in (("security", 900), ("performance", 16_500), ("style", 700), ("test", 30))]
    got = barrier_batch(spark.createDataFrame(rows, "review_id string, agent string, ts timestamp")).first()
    assert (got.seen_agents, got.complete, got.fired_at) == (3, False, t + dt.timedelta(seconds=15, milliseconds=30))


def test_late_delivery_is_not_lost(spark):
    """A webhook that comes days late is admitted; a re-delivery with an earlier time
    corrects the first; every accepted delivery has a row."""
    from revlens.streaming import keyed

    t, d = dt.datetime(2024, 1, 10), dt.timedelta(days=1)
    drops = [[("a", t, 1), ("a", t + d, 2)], [("b", t - 9 * d, 3), ("a", t - d, 4), ("a", t - d, 5)], [("a", t, 1)]]
    drops = [spark.createDataFrame(x, "k string, at timestamp, id long") for x in drops]
    folder = runner.replay(drops, "first-test", lambda s: keyed.first_per_key(s, "k", "at", F.col("id"), ttl_s=3600), files=1, idle_batches=False)
    got = sorted((r.k, r.id, r.kind) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("a", 1, "duplicate"), ("a", 1, "first"), ("a", 2, "duplicate"), ("a", 4, "earlier"), ("a", 5, "duplicate"), ("b", 3, "first")]


def test_connected_tables_and_split_landing(spark):
    """A pull request whose files land in two parts is reviewed once and whole, and the
    tables can be read by the store's own readers."""
    import json

    from pyspark.sql import functions as F

    from revlens.operators import admission as adm
    from revlens.plans.offline import no_sleep, offline_scorer_factory
    from revlens.sources import landed, store
    from revlens.streaming import pipeline, snapshots

    t, out, land = dt.datetime(2024, 1, 1), tempfile.mkdtemp(prefix="revlens-conn-"), tempfile.mkdtemp(prefix="revlens-files-")
    event = {"action": "opened", "repository": {"full_name": "o/r"}, "sender": {"login": "me"},
             "pull_request": {"number": 5, "html_url": "u", "head": {"sha": "s1"}}}
    env = spark.createDataFrame([({"X-GitHub-Event": "pull_request"}, json.dumps(event), False, t)], envelope_schema())
    admitted = adm.project_webhook_event(adm.admit(landed.webhook_envelopes(env), ""))
    events = admitted.withColumn("review_id", adm.review_key(F.col("repo_full_name"), F.col("pr_number"), F.col("head_sha"))).withColumn("kind", F.lit("first"))
    secret = "password = " + "'hunter2hunter2'"
    for part in range(2):
        row = {"filename": f"a{part}.py", "status": "added", "additions": 1, "deletions": 0, "patch": "@@ -0,0 +1 @@\n+" + secret}
        spark.createDataFrame([(5, "s1", part, json.dumps(row))], "pr_number long, head_sha string, ordinal long, file_json string").write.parquet(f"{land}/{part}")

    def files(ev):
        rows = spark.read.parquet(f"{land}/*")
        return landed.pr_files(rows.join(ev.select("review_id", "pr_number", "head_sha"), ["pr_number", "head_sha"]))

    review = pipeline.review_micro_batches(out, files, offline_scorer_factory, sleep=no_sleep)
    review(events, 0)
    review(events, 0)  # a replay
    items = snapshots.read(spark, f"{out}/items")
    keys = [(r.pk, r.sk) for r in items.collect()]
    assert len(keys) == len(set(keys)) and sum(sk.startswith("FINDING#security#") for _, sk in keys) >= 2
    meta = store.review_projection(store.reviews_from_items(items)).first()
    assert (meta.repo, meta.pr_number, meta.pr_url, meta.files_count, meta.timestamp) == ("o/r", 5, "u", 2, t)
    reported = spark.read.parquet(f"{out}/review_events")
    assert all(r.ts == t + dt.timedelta(milliseconds=r.latency_ms) for r in reported.collect())
    review(events, 1)  # admitted again: the review has two writes, and one row
    assert len(spark.read.parquet(f"{out}/review_events").collect()) == 8
    fired = barrier_batch(reported).select("review_id", F.lit("fired").alias("kind"), F.lit(0).alias("version"), "seen_agents", "complete",
        "fired_at", F.lit(4).alias("events"), F.lit("").alias("agent"), F.lit(t).alias("ts"), F.lit("").alias("event_key"))
    trigger = pipeline.trigger_micro_batches(out)
    for batch_id in (0, 0, 1):
        trigger(fired, batch_id)
    done = spark.read.parquet(f"{out}/complete")
    assert done.count() == 1 and done.first().event_type == "review.complete"
    pipeline.learning_micro_batches(out)(done.drop("batch_id"), 0)
    assert snapshots.read(spark, f"{out}/comments").count() == 1
    assert [r.sk for r in snapshots.read(spark, f"{out}/learnings").collect()] == [f"LEARNING#{meta.review_id}"]
