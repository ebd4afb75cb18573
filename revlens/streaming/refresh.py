"""The dashboard's figures, kept up by changes.

Every source of the overview becomes a stream of additive changes: a row that replaces
another one takes back what that one counted. `totals` (metric, name, value) is a snapshot
table merged by `sum`; a micro-batch adds a few rows to it, whatever the history's size, and
the overview is a fold over the totals.

* findings and reviews: `latest_values`, keyed state of the last write of each item
* queue depths: the fates of messages (`keyed.message_fates`), with retraction
* function metrics: panes of an hour, added up over the last 24 h at read time
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from revlens import rules
from revlens.operators import dashboard as dash
from revlens.streaming import keyed, snapshots

PANE_SECONDS = 3600


class LatestValue(keyed.KeyBuckets):
    """The value of each key by its last write. A write that is newer than all before
    takes the old value back (change -1) and counts its own (change 1); an older one that
    arrives late changes nothing. Changes come out summed by metric and value."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        last, changes = self.load(timerValues), Counter()
        for r in rows:
            k, write = (r["metric"], r["key"]), [r["__at"], r["__tie"], r["value"]]
            got = last.get(k)
            if got is not None:
                if write[:2] <= got[:2]:
                    continue
                changes[k[0], got[2]] -= 1
            changes[k[0], write[2]] += 1
            last[k] = write
        self.save(last)
        for (metric, name), value in changes.items():
            if value:
                yield Row(metric=metric, name=name, value=value)


def latest_values(writes: DataFrame, buckets: int = keyed.BUCKETS) -> DataFrame:
    """Changes (metric, name, value) of a stream of writes (metric, key, value, ts, tie)."""
    timed = writes.select(
        "metric", "key", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("__at"), F.col("tie").cast("long").alias("__tie")
    )
    return keyed.by_bucket(timed, "metric", "key", buckets=buckets).transformWithState(
        LatestValue(), "metric string, name string, value long", "Append", "None"
    )


def finding_writes(findings: DataFrame, key: Column, tie: Column) -> DataFrame:
    """Finding items as writes: what counts is the severity."""
    sev = F.lower(F.coalesce(F.col("severity"), F.lit("info")))
    return findings.select(F.lit("severity").alias("metric"), key.alias("key"), sev.alias("value"), "ts", tie.alias("tie"))


def review_writes(reviews: DataFrame, tie: Column) -> DataFrame:
    """META items as writes: each review counts once."""
    return reviews.select(F.lit("reviews").alias("metric"), F.col("review_id").alias("key"), F.lit("total").alias("value"), "ts", tie.alias("tie"))


def fate_changes(fates: DataFrame) -> DataFrame:
    """Waiting messages by queue, as changes, from `keyed.message_fates` rows."""
    dlq = F.regexp_replace("queue", "-queue$", "-dlq")
    return fates.where("route <> 'acked'").select(
        F.lit("depth").alias("metric"), F.when(F.col("route") == "dead", dlq).otherwise(F.col("queue")).alias("name"),
        F.col("change").cast("long").alias("value"),
    )


def pane_changes(invocations: DataFrame) -> DataFrame:
    """Invocations by function and hour: counts, errors, and durations in integer
    hundredths of a millisecond, so that sums do not depend on their order."""
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (PANE_SECONDS * 1_000_000)) * PANE_SECONDS).cast("long")
    hundredths = F.round(F.col("duration_ms") * 100).cast("bigint")
    return invocations.groupBy("function", start.alias("pane")).agg(
        F.count(F.lit(1)).alias("invocations"), F.count_if("is_error").alias("errors"), F.sum(hundredths).alias("hundredths"),
        F.count("duration_ms").alias("timed"),
    )


def totals_micro_batches(out_dir: str, changes: Callable[[DataFrame], DataFrame] = lambda df: df, name: str = "totals"):
    """foreachBatch function: add a micro-batch's changes to the totals. Each stream has
    a table of its own (`name`), so each has one writer."""

    def run(rows: DataFrame, batch_id: int) -> None:
        summed = changes(rows).groupBy("metric", "name").agg(F.sum("value").alias("value"))
        snapshots.commit(summed, f"{out_dir}/{name}", batch_id, ["metric", "name"], merge="sum")

    return run


def pane_micro_batches(out_dir: str):
    """foreachBatch function: add a micro-batch of invocations to their panes."""

    def run(rows: DataFrame, batch_id: int) -> None:
        snapshots.commit(pane_changes(rows), f"{out_dir}/panes", batch_id, ["function", "pane"], merge="sum")

    return run


def pane_metrics(spark: SparkSession, panes: DataFrame, now: str, hours: int = rules.METRIC_LOOKBACK_HOURS) -> DataFrame:
    """The metrics of `dashboard.function_metrics` from panes; `now` is on the hour."""
    end = F.unix_timestamp(F.to_timestamp(F.lit(now)))
    window = panes.where((F.col("pane") >= end - hours * 3600) & (F.col("pane") < end))
    tenths = F.floor((F.col("h") * 2 + F.col("n") * 10) / (F.col("n") * 20))
    return window.groupBy("function").agg(
        F.sum("invocations").alias("invocations_24h"), F.sum("errors").alias("errors_24h"),
        F.sum("hundredths").alias("h"), F.sum("timed").alias("n"),
    ).select("function", "invocations_24h", "errors_24h", (tenths / 10.0).cast("double").alias("avg_duration_ms"))


def overview(spark: SparkSession, out_dir: str, now: str) -> DataFrame:
    """The overview row from the totals as they stand (columns of `dashboard.overview`)."""
    totals = snapshots.read(spark, f"{out_dir}/totals").unionByName(snapshots.read(spark, f"{out_dir}/depths"))
    def value(metric: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("metric") == metric) & (F.col("name") == name), F.col("value"))), F.lit(0)).cast("bigint")

    severity = totals.agg(*[value("severity", s).alias(s) for s in rules.SEVERITIES])
    severity = severity.withColumn("total", sum((F.col(s) for s in rules.SEVERITIES), F.lit(0)).cast("bigint"))
    reviews = totals.agg(value("reviews", "total").alias("total_reviews"))
    depth = totals.where("metric = 'depth' AND value <> 0").select(F.col("name").alias("queue"), F.col("value").alias("depth"))
    metrics = pane_metrics(spark, snapshots.read(spark, f"{out_dir}/panes"), now)
    return dash.overview(severity, reviews, dash.queue_depth_all(spark, depth), dash.function_metrics_all(spark, metrics))
