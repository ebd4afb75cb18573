"""Message lifecycle: retention and visibility-timeout redelivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens import rules


def retained(routes: DataFrame, now: str, main_s: int = rules.RETENTION_MAIN_SECONDS,
             dead_s: int = rules.RETENTION_DEAD_SECONDS) -> DataFrame:
    """Messages still held at `now`: a queue keeps a message `main_s` after it
    was sent; the dead-letter queue keeps it `dead_s` after it moved there.
    (On a stream the same horizon is the watermark delay.)"""
    end = F.to_timestamp(F.lit(now))
    keep_dead = (F.col("route") == "dead") & (F.col("last_received_at") > end - F.make_dt_interval(secs=F.lit(dead_s)))
    keep_main = (F.col("route") != "dead") & (F.col("first_received_at") > end - F.make_dt_interval(secs=F.lit(main_s)))
    return routes.filter(keep_dead | keep_main)


def redeliveries(receives: DataFrame, visibility_s: int = rules.VISIBILITY_SECONDS,
                 learn_visibility_s: int = rules.VISIBILITY_SECONDS_LEARN) -> DataFrame:
    """Classify each receive by the gap to the same message's next receive:
    `after_timeout` (>= the queue's visibility timeout - 120 s for the learn
    queue, 300 s for the others: the message became visible again), `early`
    (shorter) or `last`.

    The window is per message; a message is received at most a handful of
    times before it is acknowledged or dead-lettered, so each window
    partition is small whatever the table size.
    """
    w = Window.partitionBy("message_id").orderBy("received_at", "receive_seq")
    nxt = F.lead("received_at").over(w)
    gap = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("received_at").cast("timestamp"))
    timeout_us = F.when(F.col("queue") == "learn-queue", F.lit(learn_visibility_s)).otherwise(F.lit(visibility_s)) * 1_000_000
    return receives.withColumn("gap_us", gap).withColumn(
        "kind",
        F.when(F.col("gap_us").isNull(), F.lit("last"))
        .when(F.col("gap_us") >= timeout_us, F.lit("after_timeout"))
        .otherwise(F.lit("early")),
    )
