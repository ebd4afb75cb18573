"""Completion barrier: one summary trigger per review, when all reviewers have
reported or when the review's time budget runs out.

Event-time semantics: a review opens at its first finding event `t0`. The
distinct reviewers first seen within [t0, t0 + timeout] count: with `expected` of
them the barrier is complete and fires at the last one's first event, else it
fires at t0 + timeout with those that arrived. It fires once per review; events
that arrive after it fired are late.

Two forms:
* `barrier_batch` - two partial aggregations (first event per reviewer, then
  per review); skew-safe.
* `barrier_stream` - keyed state with event-time timers (`keyed.Barrier`). A review with
  all reviewers fires at once, another when the watermark passes its deadline. No row is
  dropped for being late: an event of a review that has fired comes out as `late`, and if
  it changes the decision an `amended` row follows. `decisions` takes the last version of
  each review, which equals the batch form for any order and any micro-batches. Triggers
  are the `fired` rows; the state of a review is a few bytes whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import rules
from revlens.operators.ordering import first_by_order
from revlens.streaming import keyed, sinks

def barrier_batch(events: DataFrame, timeout_s: int = rules.BARRIER_TIMEOUT_SECONDS,
                  expected: int = rules.EXPECTED_REVIEWERS) -> DataFrame:
    """Batch form over finding events (review_id, agent, ts); rows without an
    agent are ignored."""
    first = events.filter(F.col("agent").isNotNull()).groupBy("review_id", "agent").agg(F.min(F.col("ts").cast("timestamp")).alias("first_ts"))
    opened = first.groupBy("review_id").agg(F.min("first_ts").alias("t0"))
    deadline = F.col("t0") + F.make_dt_interval(secs=F.lit(timeout_s))
    joined = first.join(opened, "review_id").withColumn("in_window", F.col("first_ts") <= deadline)
    per = joined.groupBy("review_id").agg(
        F.count_if("in_window").cast("int").alias("seen_agents"),
        F.max(F.when(F.col("in_window"), F.col("first_ts"))).alias("last_in_window"),
        F.min("t0").alias("t0"),
    )
    complete = F.col("seen_agents") >= expected
    return per.select(
        "review_id",
        "seen_agents",
        complete.alias("complete"),
        F.when(complete, F.col("last_in_window"))
        .otherwise(F.col("t0") + F.make_dt_interval(secs=F.lit(timeout_s)))
        .alias("fired_at"),
    )


def barrier_stream(events: DataFrame, timeout_s: int = rules.BARRIER_TIMEOUT_SECONDS,
                   expected: int = rules.EXPECTED_REVIEWERS, watermark: str = "1 minute",
                   retention_s: int | None = None, event_key: Column | None = None) -> DataFrame:
    """Streaming form over a finding-event stream (review_id, agent, ts); rows as
    `keyed.BARRIER_SCHEMA`.

    Rows with a NULL agent (other events on the same stream) are not counted but move the
    clock. `event_key` names an event in its late row. With `retention_s` the state of a
    review goes that long after it fired; events older than that of a review without state
    then come out as late and decide nothing. Without it state stays, a few bytes a review."""
    slim = keyed.with_clock(events, "ts", watermark, [
        F.col("review_id"), F.col("agent"), F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"),
        (F.lit(None) if event_key is None else event_key).cast("string").alias("event_key"),
    ], counted=F.col("agent").isNotNull())
    rows = slim.groupBy("review_id").transformWithState(
        keyed.Barrier(timeout_s, expected, retention_s), keyed.as_longs(keyed.BARRIER_SCHEMA), "Append", "EventTime"
    )
    return keyed.times(rows, "fired_at", "ts")


def barrier_micro_batches(out_dir: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over barrier rows with two outputs: `triggers` (fired and
    amended decisions) and `late_findings` (one row per event that came too late)."""

    def run(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        sinks.write_batch(rows.where("kind <> 'late'").drop("agent", "ts", "event_key"), f"{out_dir}/triggers", batch_id)
        late = rows.where("kind = 'late'").select("review_id", "agent", "ts", "event_key", "fired_at")
        sinks.write_batch(late, f"{out_dir}/late_findings", batch_id)
        rows.unpersist()

    return run


def decisions(triggers: DataFrame) -> DataFrame:
    """The decision of each review as it stands: its last version."""
    rows = triggers.where("kind IN ('fired', 'amended')").select("review_id", "version", "seen_agents", "complete", "fired_at", "events")
    return first_by_order(rows, ["review_id"], ["version"], descending=True)
