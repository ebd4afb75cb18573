"""Streaming compositions of the review service.

    envelopes --admit, project--> accepted events --state per review--> first, earlier, duplicate
    first events --per micro-batch: landed files of those reviews, batch review--> tables
    tables/review_events --barrier (state)--> triggers, late_findings
    triggers --comment, complete--> tables/comments, outbox of complete messages
    complete messages --skip empty ids--> tables/learnings

The tables are the review store: `items` rows (pk, sk, attrs, write_ts) of META and
findings, `verdicts`, `comments` and `learnings` are snapshot tables (`snapshots`: whole
versions, merged as they grow); `review_events` and `complete` are logs that streams read,
a folder per micro-batch. Every sink is idempotent per batch id and lives under
spark.checkpoint.dir; every query has its own checkpoint folder, so each part fails and
restarts on its own. No stream drops a row for being late (`keyed`).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import admission as adm
from revlens.operators.review_events import assemble_review_events
from revlens.plans.batch import review_batch
from revlens.session import materialise
from revlens.sources import landed, store
from revlens.streaming import barrier, keyed, outbox, sinks, snapshots


def admission_stream(envelopes: DataFrame, secret: str, ttl_s: int | None = 4 * 86_400, tie: str | None = None) -> DataFrame:
    """Accepted, projected webhook events from an envelope stream (needs `received_at`),
    with review_id and `kind`: the `first` delivery of a pull request's head starts its
    review, `earlier` ones came later but carry an older time, the rest are `duplicate`.
    Every accepted delivery comes out, however late. A head is forgotten `ttl_s` after its
    last delivery: as long as the queue keeps messages."""
    admitted = adm.admit(landed.webhook_envelopes(envelopes), secret)
    keep = ["received_at", *adm.EVENT_COLUMNS, *([] if tie is None else [tie])]
    events = adm.accepted_only(adm.project_webhook_event(admitted), keep)
    keyed_events = events.withColumn("review_id", adm.review_key(F.col("repo_full_name"), F.col("pr_number"), F.col("head_sha")))
    return keyed.first_per_key(keyed_events, "review_id", "received_at", None if tie is None else F.col(tie), ttl_s)


def meta_items(events: DataFrame, b) -> DataFrame:
    """META items of reviewed events: what the event says of the pull request, and the
    review's counts and elapsed time."""
    chunks = b.chunk_counts.groupBy("review_id").agg(F.max("total_chunks").alias("chunks_count"))
    zero = F.lit(0).cast("bigint")
    rows = (
        events.join(b.stats, "review_id").join(chunks, "review_id", "left")
        .join(b.verdicts.select("review_id", "latency_ms"), "review_id", "left")
    )
    return store.review_items(rows.select(
        "review_id", F.col("repo_full_name").alias("repo"), "pr_number", "pr_url", "sender", "head_sha",
        F.lit("parsing_complete").alias("status"), F.col("received_at").alias("created_at"),
        F.col("total_files").alias("files_count"), F.coalesce("chunks_count", zero).alias("chunks_count"),
        F.coalesce("latency_ms", zero).alias("latency_ms"), F.col("received_at").alias("write_ts"),
    ), keep=("write_ts",))


def review_micro_batches(
    out_dir: str,
    landed_files: Callable[[DataFrame], DataFrame],
    scorer_factory: Callable,
    sleep: Callable[[float], None] = time.sleep,
    brand: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over admitted events (review_id, received_at, kind): review
    all landed files of the first deliveries' reviews and write the tables.

    The work is keyed on the event, not on the arrival of files: `landed_files(events)`
    gives the events' file rows (review_id, ordinal, ...) as landed by now, so a review
    is made once and whole however its files arrived.
    """

    def run(events: DataFrame, batch_id: int) -> None:
        admitted = events.where("kind = 'first'").drop("kind").persist()
        # all stages and tables see the files as they were landed by now, read once
        files = landed_files(admitted).persist()
        b = review_batch(files, scorer_factory, sleep=sleep, brand=brand)
        b.store_small()
        # only events with files have rows below; the others are joined no more
        events = materialise(admitted.join(b.stats.select("review_id"), "review_id", "left_semi"))
        findings = b.findings.join(
            events.select("review_id", F.col("repo_full_name").alias("repo"), "pr_number", F.col("received_at").alias("write_ts")),
            "review_id",
        )
        items = meta_items(events, b).unionByName(store.finding_items(findings, keep=("write_ts",)))
        snapshots.commit(items, f"{out_dir}/items", batch_id, ["pk", "sk"], ["write_ts"])
        # review.<agent> events, one per review and reviewer even without findings: fed
        # to `barrier_stream` every reviewer that finished counts. A reviewer finishes when
        # the model has answered all of its chunks: the event's time and that latency, so
        # a replayed batch gives the same rows and a slow reviewer can miss the deadline.
        reported = assemble_review_events(b.stats, b.chunk_counts, b.findings, b.decoded).join(
            events.select("review_id", F.col("received_at").alias("started")), "review_id"
        )
        done = F.timestamp_micros(F.unix_micros("started") + F.col("latency_ms") * 1000)
        reported = reported.withColumn("ts", done).drop("started")
        sinks.write_batch(reported, f"{out_dir}/review_events", batch_id)
        verdicts = b.comments.join(b.status.select("review_id", "state", "description"), "review_id").join(
            b.verdicts.drop("verdict"), "review_id"
        ).join(events.select("review_id", F.col("received_at").alias("write_ts")), "review_id")
        snapshots.commit(verdicts, f"{out_dir}/verdicts", batch_id, ["review_id"], ["write_ts"])
        files.unpersist()
        admitted.unpersist()

    return run


def trigger_micro_batches(out_dir: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over barrier rows: the comment and the completion message
    of each review whose summary is triggered now. Late events and amended decisions go
    to `late_findings` and `triggers`; they trigger nothing again."""
    record = barrier.barrier_micro_batches(out_dir)

    def run(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        record(rows, batch_id)
        fired = rows.where("kind = 'fired'").select("review_id", F.col("fired_at").alias("ts"), "seen_agents", "complete")
        verdicts = snapshots.read(rows.sparkSession, f"{out_dir}/verdicts").drop("write_ts")
        due = verdicts.join(fired, "review_id").persist()
        snapshots.commit(due, f"{out_dir}/comments", batch_id, ["review_id"], ["ts"])
        outbox.publish(complete_messages(due), f"{out_dir}/complete", batch_id)
        due.unpersist()
        rows.unpersist()

    return run


def complete_messages(verdicts: DataFrame) -> DataFrame:
    """review.complete messages (`review_id`, `body`, `event_type`, `ts`)."""
    body = F.to_json(F.struct("review_id", "verdict", "total_findings", F.col("latency_ms").cast("int").alias("latency_ms")))
    return verdicts.select("review_id", body.alias("body"), F.lit("review.complete").alias("event_type"), "ts")


def learning_micro_batches(out_dir: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over review.complete messages (`body`, `ts`):
    unwrap, skip messages without review_id, write learning items; readers
    take the latest per (pk, sk)."""

    def run(messages: DataFrame, batch_id: int) -> None:
        payload = F.try_parse_json(landed.unwrap_envelope(F.col("body")))
        parsed = messages.select(
            F.coalesce(F.variant_get(payload, "$.review_id", "string"), F.lit("")).alias("review_id"),
            F.variant_get(payload, "$.verdict", "string").alias("verdict"),
            F.col("ts").alias("write_ts"),
        )
        # the message's own time: a replay, or a later run, orders writes alike
        snapshots.commit(store.learning_items(parsed, keep=("write_ts",)), f"{out_dir}/learnings", batch_id, ["pk", "sk"], ["write_ts"])

    return run


def dead_letter_micro_batches(out_dir: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over message fates (`keyed.message_fates`): the fate of each
    message as it stands in the snapshot table `routes`, those that are dead in
    `dead_letters`. Work follows the micro-batch, not the history."""

    def run(fates: DataFrame, batch_id: int) -> None:
        now = fates.where("change = 1").drop("change").persist()
        snapshots.commit(now, f"{out_dir}/routes", batch_id, ["message_id"], ["version"])
        sinks.write_batch(now.where("route = 'dead'"), f"{out_dir}/dead_letters", batch_id)
        now.unpersist()

    return run
