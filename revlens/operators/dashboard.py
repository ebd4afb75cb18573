"""Dashboard tables: KPIs, queue depth, function metrics, health flags.

Everything is a partial aggregate. Where the dashboard lists a fixed set of names
(14 queues, 6 functions), those are stacked under the aggregate and folded per
name, so names without data appear and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import rules
from revlens.functions.text import category_label, finding_location


def severity_kpi(findings: DataFrame) -> DataFrame:
    """One row: global counts per severity (lower-cased, missing -> info);
    severities outside the three are not counted; total = sum of the three."""
    sev = F.lower(F.coalesce(F.col("severity"), F.lit("info")))
    counts = findings.agg(*[F.count_if(sev == s).alias(s) for s in rules.SEVERITIES])
    return counts.withColumn("total", sum((F.col(s) for s in rules.SEVERITIES), F.lit(0)).cast("bigint"))


def review_count_kpi(items: DataFrame) -> DataFrame:
    return items.filter(F.col("sk").startswith("META")).agg(F.count(F.lit(1)).alias("total_reviews"))


def queue_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, i) for i, q in enumerate(rules.QUEUES)], "queue string, queue_order int")


def function_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, runtime, mem, timeout, i) for i, (name, runtime, mem, timeout) in enumerate(rules.FUNCTIONS)],
        "function string, runtime string, memory int, timeout int, function_order int",
    )


def message_routes(receives: DataFrame, max_receives: int = rules.MAX_RECEIVES) -> DataFrame:
    """Fate of every message from its receive log.

    Walking receives in time order, a message is `acked` when a receive
    succeeds before `max_receives` failures, `dead` (moved to the dead-letter
    queue) once it has failed `max_receives` times, else `retry` (visible
    again, waiting). Two partial aggregations (first success time, then
    failures before it); no per-message sort.
    """
    first_ok = receives.groupBy("message_id").agg(
        F.min(F.when(F.col("succeeded"), F.struct("received_at", "receive_seq"))).alias("__ok")
    )
    before_ok = F.col("__ok").isNull() | (
        F.struct("received_at", "receive_seq") < F.col("__ok")
    )
    per_msg = (
        receives.join(first_ok, "message_id")
        .groupBy("message_id")
        .agg(
            F.min_by("queue", F.struct("received_at", "receive_seq")).alias("queue"),
            F.min("received_at").alias("first_received_at"),
            F.max("received_at").alias("last_received_at"),
            F.count(F.lit(1)).alias("receives"),
            F.count_if(~F.col("succeeded") & before_ok).alias("failures"),
            F.max(F.col("__ok").isNotNull()).alias("has_ok"),
        )
    )
    return per_msg.withColumn(
        "route",
        F.when(F.col("failures") >= max_receives, F.lit("dead"))
        .when(F.col("has_ok"), F.lit("acked"))
        .otherwise(F.lit("retry")),
    ).drop("has_ok")


def queue_depth(routes: DataFrame) -> DataFrame:
    """Messages waiting per queue: `retry` messages sit in their queue, `dead`
    ones in the queue's dead-letter queue."""
    located = routes.filter(F.col("route") != "acked").select(
        F.when(F.col("route") == "dead", F.regexp_replace("queue", "-queue$", "-dlq")).otherwise(F.col("queue")).alias("queue")
    )
    return located.groupBy("queue").agg(F.count(F.lit(1)).alias("depth"))


def queue_depth_all(spark: SparkSession, depth: DataFrame) -> DataFrame:
    """Every configured queue, depth 0 when absent, plus health columns: the
    configured names are stacked under the counts and added up per queue, which
    gives the left join's rows without a side to broadcast."""
    known = queue_table(spark).select("queue", F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("configured"))
    rows = depth.select("queue", "depth", F.lit(False).alias("configured")).unionByName(known)
    per_queue = rows.groupBy("queue").agg(F.sum("depth").alias("depth"), F.max("configured").alias("configured"))
    return per_queue.where("configured").select(
        "queue", "depth", F.col("queue").contains("dlq").alias("is_dlq"), (F.col("depth") > 0).alias("has_messages")
    )


def exact_mean_tenths(duration_ms) -> tuple:
    """(partial aggregates, final expression) for a mean duration rounded
    half-up to 0.1 ms that does not depend on partitioning: durations are
    summed as integer hundredths of a millisecond (exact in any order) and
    the rounding is integer arithmetic. A floating-point average would change
    in its last bits with the summation order and flip roundings."""
    hundredths = F.round(duration_ms * 100).cast("bigint")
    parts = [F.sum(hundredths).alias("__sum_h"), F.count(duration_ms).alias("__n")]
    tenths = F.floor((F.col("__sum_h") * 2 + F.col("__n") * 10) / (F.col("__n") * 20))
    return parts, (tenths / 10.0).cast("double")


def function_metrics(invocations: DataFrame, now: str, hours: int = rules.METRIC_LOOKBACK_HOURS) -> DataFrame:
    """Per function over [now - hours, now): invocations, errors, mean
    duration rounded to 0.1 ms (exact, see `exact_mean_tenths`). The time
    filter is pushed to the scan."""
    end = F.to_timestamp(F.lit(now))
    window = invocations.filter((F.col("ts") >= end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") < end))
    parts, mean = exact_mean_tenths(F.col("duration_ms"))
    agg = window.groupBy("function").agg(
        F.count(F.lit(1)).alias("invocations_24h"),
        F.count_if(F.col("is_error")).alias("errors_24h"),
        *parts,
    )
    return agg.select("function", "invocations_24h", "errors_24h", mean.alias("avg_duration_ms"))


def function_metrics_all(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    """Every configured function with its configuration, metrics 0 when absent,
    and the health flag (`warning` when it had errors, else `active`)."""
    fixed = ["runtime", "memory", "timeout"]
    figures = ["invocations_24h", "errors_24h", "avg_duration_ms"]
    rows = metrics.select("function", *figures).unionByName(function_table(spark).select("function", *fixed), allowMissingColumns=True)
    m = rows.groupBy("function").agg(*[F.max(c).alias(c) for c in [*fixed, *figures]]).where("timeout IS NOT NULL")
    errors = F.coalesce(F.col("errors_24h"), F.lit(0)).cast("bigint")
    return m.select(
        "function",
        "runtime",
        "memory",
        "timeout",
        F.lit("Active").alias("state"),
        F.coalesce(F.col("invocations_24h"), F.lit(0)).cast("bigint").alias("invocations_24h"),
        errors.alias("errors_24h"),
        F.coalesce(F.col("avg_duration_ms"), F.lit(0.0)).cast("double").alias("avg_duration_ms"),
        F.when(errors > 0, F.lit("warning")).otherwise(F.lit("active")).alias("health"),
    )


def _by_name(name: str, value: str):
    """{name: value} of a fixed table's rows (a dozen at most)."""
    return F.map_from_entries(F.collect_list(F.struct(name, F.col(value))))


def overview(severity: DataFrame, reviews: DataFrame, queues: DataFrame, functions: DataFrame) -> DataFrame:
    """One-row overview: reviews, findings by severity, depth of each queue, and
    invocations and errors of each function. Every input is reduced to one row
    first; the rows are stacked (missing columns NULL) and folded per column - no
    join of any kind."""
    maps = ["queues", "invocations", "errors"]
    q = queues.agg(_by_name("queue", "depth").alias("queues"))
    f = functions.agg(
        _by_name("function", "invocations_24h").alias("invocations"), _by_name("function", "errors_24h").alias("errors")
    )
    stacked = (
        reviews.select("total_reviews")
        .unionByName(severity.select(F.col("total").alias("total_findings"), *rules.SEVERITIES), allowMissingColumns=True)
        .unionByName(q, allowMissingColumns=True)
        .unionByName(f, allowMissingColumns=True)
    )
    counts = ["total_reviews", "total_findings", *rules.SEVERITIES]
    return stacked.agg(
        *[F.max(c).alias(c) for c in counts], *[F.first(c, ignorenulls=True).alias(c) for c in maps]
    )


def finding_display(findings: DataFrame) -> DataFrame:
    """Display columns of a finding: category label, location, badge."""
    return findings.select(
        "*",
        category_label(F.col("category")).alias("category_label"),
        finding_location(F.col("file"), F.col("line")).alias("location"),
    )


def seen_agents(findings: DataFrame, expected: int = rules.EXPECTED_REVIEWERS) -> DataFrame:
    """Reviewers with at least one finding per review, and whether all
    `expected` have reported."""
    per = findings.groupBy("review_id").agg(F.count_distinct("agent").alias("seen_agents"))
    return per.withColumn("complete", F.col("seen_agents") >= expected)


def seen_agents_stream(findings: DataFrame, expected: int = rules.EXPECTED_REVIEWERS) -> DataFrame:
    """Streaming form of `seen_agents` (update / complete output mode).
    `count_distinct` is not supported on streams; the reviewer set per review
    is bounded (4 names), so `size(collect_set(agent))` is."""
    per = findings.groupBy("review_id").agg(F.size(F.collect_set("agent")).alias("seen_agents"))
    return per.withColumn("complete", F.col("seen_agents") >= expected)


def recent_reviews(projected: DataFrame, limit: int = rules.RECENT_REVIEWS_LIMIT) -> DataFrame:
    """The true latest `limit` reviews, newest first (a top-k: each task keeps
    its own top `limit`, then one merge)."""
    return projected.orderBy(F.col("timestamp").desc_nulls_last(), F.col("review_id")).limit(limit)


def token_usage(decoded: DataFrame) -> DataFrame:
    """Tokens and latency per review x reviewer x model with rollup totals
    (NULL agent/model rows are the per-review and grand totals)."""
    return decoded.rollup("review_id", "agent", "model_id").agg(
        F.sum("tokens_in_counted").cast("bigint").alias("tokens_in"),
        F.sum("tokens_out_counted").cast("bigint").alias("tokens_out"),
        F.sum(F.when(F.col("outcome") != "model_error", F.col("latency_ms"))).cast("bigint").alias("latency_ms"),
        F.count(F.lit(1)).alias("chunks"),
    )
