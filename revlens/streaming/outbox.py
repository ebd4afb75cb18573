"""Outbox of published messages: a replay publishes nothing twice.

A message's id is a digest of its topic, key and body, so the same message has the same id
in every run. A publisher writes one folder per micro-batch, replaced whole when the
micro-batch is replayed, with the message's attributes as partition columns, so that a
subscriber of one event type reads only its folders. Messages that earlier micro-batches
published are left out: a keyed snapshot table remembers the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.streaming import sinks, snapshots


def message_id(topic: str):
    return F.sha2(F.concat_ws("\x1f", F.lit(topic), F.col("review_id"), F.col("body")), 256)


def publish(messages: DataFrame, path: str, batch_id: int) -> None:
    """Publish (review_id, body, event_type, ts) once each, with `message_id` and
    `sequence` (the micro-batch) as their place in the log."""
    spark = messages.sparkSession
    known = f"{path}-published"
    rows = messages.withColumn("message_id", message_id("complete")).dropDuplicates(["message_id"])
    if snapshots.versions(spark, known):
        before = snapshots.read(spark, known).where(F.col("sequence") < int(batch_id)).select("message_id")
        rows = rows.join(before, "message_id", "left_anti")
    rows = rows.withColumn("sequence", F.lit(int(batch_id)).cast("long")).persist()
    sinks.write_batch(rows, path, batch_id, partition_by=["event_type"])
    snapshots.commit(rows.select("message_id", "sequence"), known, batch_id, ["message_id"], ["sequence"])
    rows.unpersist()
