"""Store and dashboard queries: KPIs, queues, functions, reviews, items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import rules
from revlens.operators import dashboard as dash
from revlens.operators.parse import drop_generated
from revlens.operators.scan import secret_scan
from revlens.plans import oracle as o
from revlens.plans.q_findings import keyed_findings
from revlens.plans.q_parse import _CHANGES, changes
from revlens.plans.registry import register
from revlens.session import configure
from revlens.sources import store
from revlens.sources.driver import EVENTS_NOW, derived
from revlens.streaming import runner, sinks, status_index


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return store.reviews_from_events(derived(spark, sf_dir, "review_events"))


_STORED: dict[tuple, str] = {}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.review_items(reviews(spark, sf_dir)).unionByName(store.finding_items(keyed_findings(spark, sf_dir)))


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items table as the store keeps it (bucketed by pk, sorted by pk, sk)
    in the shared folder, written once for an application and input, and read so
    that lookups prune and push down."""
    from revlens.session import scratch_path

    key = (spark.sparkContext.applicationId, sf_dir, store.item_buckets(spark))
    if key not in _STORED:
        _STORED[key] = scratch_path(spark, f"items-{uuid.uuid4().hex[:12]}")
        store.write_items(items(spark, sf_dir), _STORED[key])
    return store.read_items(spark, _STORED[key])


_FINDINGS = o.with_views("findings_in") + " "
_REVIEWS = (
    o.with_views("review_events", "findings_in")
    + """, reviews AS (
  SELECT review_id, max(repo) AS repo, max(pr_number) AS pr_number, max(pr_url) AS pr_url, max(status) AS status,
         min(ts) AS created_at, count(*) AS files_count, count(*) FILTER (WHERE event_type = 'view') AS chunks_count
  FROM review_events GROUP BY review_id),
keyed AS (
  SELECT *, 'FINDING#' || agent || '#' || cast(row_number() OVER (PARTITION BY review_id, agent ORDER BY ordinal) - 1 AS varchar) AS sk
  FROM findings_in),
items AS (
  SELECT 'REV#' || review_id AS pk, 'META' AS sk, status AS status_attr FROM reviews
  UNION ALL
  SELECT 'REV#' || review_id AS pk, sk, NULL FROM keyed)
"""
)


# --- KPIs ------------------------------------------------------------------------
def _sev_kpi_sql(source: str) -> str:
    sev = "lower(coalesce(severity, 'info'))"
    return (
        f"SELECT count(*) FILTER (WHERE {sev} = 'critical') AS critical, count(*) FILTER (WHERE {sev} = 'warning') AS warning, "
        f"count(*) FILTER (WHERE {sev} = 'info') AS info, "
        f"count(*) FILTER (WHERE {sev} IN ('critical', 'warning', 'info')) AS total FROM {source}"
    )


@register("severity_kpi", _FINDINGS + _sev_kpi_sql("findings_in"))
def q_severity_kpi(spark, sf_dir):
    configure(spark)
    return dash.severity_kpi(derived(spark, sf_dir, "findings_in"))


@register(
    "severity_kpi_secrets",
    _CHANGES + ", secrets AS (" + o.secret_findings_sql() + ") " + _sev_kpi_sql("secrets"),
)
def q_severity_kpi_secrets(spark, sf_dir):
    """Flagship: secret findings of the planted diffs, counted by severity."""
    return dash.severity_kpi(secret_scan(drop_generated(changes(spark, sf_dir))))


@register("review_count_kpi", _REVIEWS + "SELECT count(*) AS total_reviews FROM items WHERE starts_with(sk, 'META')")
def q_review_count_kpi(spark, sf_dir):
    return dash.review_count_kpi(store.review_items(reviews(spark, sf_dir)))  # only META items count


# --- queues --------------------------------------------------------------------
_ROUTES_BODY = (
    """, first_ok AS (
  SELECT message_id, min(received_at) FILTER (WHERE succeeded) AS ok_at,
         arg_min(receive_seq, received_at) FILTER (WHERE succeeded) AS ok_seq
  FROM receives GROUP BY message_id),
routes AS (
  SELECT message_id, arg_min(queue, (received_at, receive_seq)) AS queue, min(received_at) AS first_received_at,
         max(received_at) AS last_received_at, count(*) AS receives,
         count(*) FILTER (WHERE NOT succeeded AND (ok_at IS NULL OR received_at < ok_at
                          OR (received_at = ok_at AND receive_seq < ok_seq))) AS failures,
         bool_or(ok_at IS NOT NULL) AS has_ok
  FROM receives JOIN first_ok USING (message_id) GROUP BY message_id),
routed AS (
  SELECT * EXCLUDE (has_ok), CASE WHEN failures >= 3 THEN 'dead' WHEN has_ok THEN 'acked' ELSE 'retry' END AS route
  FROM routes),
depth AS (
  SELECT CASE WHEN route = 'dead' THEN regexp_replace(queue, '-queue$', '-dlq') ELSE queue END AS queue, count(*) AS depth
  FROM routed WHERE route <> 'acked' GROUP BY 1),
queues AS (SELECT * FROM (VALUES """
    + ", ".join(f"({o.q(q)}, {i})" for i, q in enumerate(rules.QUEUES))
    + """) t(queue, queue_order)),
queue_all AS (
  SELECT queue, cast(coalesce(depth, 0) AS BIGINT) AS depth, contains(queue, 'dlq') AS is_dlq,
         coalesce(depth, 0) > 0 AS has_messages
  FROM queues LEFT JOIN depth USING (queue))
"""
)
_ROUTES = o.with_views("receives") + _ROUTES_BODY


def routes(spark, sf_dir):
    configure(spark)
    return dash.message_routes(derived(spark, sf_dir, "receives"))


@register("dead_letter_route", _ROUTES + "SELECT message_id, queue, receives, failures, route FROM routed")
def q_dead_letter_route(spark, sf_dir):
    return routes(spark, sf_dir).select("message_id", "queue", "receives", "failures", "route")


@register("queue_depth", _ROUTES + "SELECT queue, depth FROM depth")
def q_queue_depth(spark, sf_dir):
    return dash.queue_depth(routes(spark, sf_dir))


@register("queue_depth_left_join", _ROUTES + "SELECT * FROM queue_all")
def q_queue_depth_left_join(spark, sf_dir):
    return dash.queue_depth_all(spark, dash.queue_depth(routes(spark, sf_dir)))


# --- functions -----------------------------------------------------------------
_FUNCS_BODY = (
    f""", metrics AS (
  SELECT function, count(*) AS invocations_24h, count(*) FILTER (WHERE is_error) AS errors_24h,
         cast(floor((sum(cast(round(duration_ms * 100) AS BIGINT)) * 2 + count(duration_ms) * 10)
                    / (count(duration_ms) * 20)) / 10.0 AS DOUBLE) AS avg_duration_ms
  FROM invocations
  WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOURS AND ts < TIMESTAMP '{EVENTS_NOW}'
  GROUP BY function),
funcs AS (SELECT * FROM (VALUES """
    + ", ".join(f"({o.q(n)}, {o.q(r)}, {m}, {t})" for n, r, m, t in rules.FUNCTIONS)
    + """) t(function, runtime, memory, timeout)),
func_all AS (
  SELECT function, runtime, memory, timeout, 'Active' AS state,
         cast(coalesce(invocations_24h, 0) AS BIGINT) AS invocations_24h,
         cast(coalesce(errors_24h, 0) AS BIGINT) AS errors_24h,
         cast(coalesce(avg_duration_ms, 0.0) AS DOUBLE) AS avg_duration_ms,
         CASE WHEN coalesce(errors_24h, 0) > 0 THEN 'warning' ELSE 'active' END AS health
  FROM funcs LEFT JOIN metrics USING (function))
"""
)
_FUNCS = o.with_views("invocations") + _FUNCS_BODY


def metrics(spark, sf_dir):
    configure(spark)
    return dash.function_metrics(derived(spark, sf_dir, "invocations"), EVENTS_NOW)


@register("function_metrics_24h", _FUNCS + "SELECT * FROM metrics")
def q_function_metrics_24h(spark, sf_dir):
    return metrics(spark, sf_dir)


@register("function_metrics_left_join", _FUNCS + "SELECT * FROM func_all")
def q_function_metrics_left_join(spark, sf_dir):
    return dash.function_metrics_all(spark, metrics(spark, sf_dir))


@register(
    "invocations_total",
    _FUNCS + "SELECT cast(sum(invocations_24h) AS BIGINT) AS invocations_24h, cast(sum(errors_24h) AS BIGINT) AS errors_24h FROM func_all",
)
def q_invocations_total(spark, sf_dir):
    return dash.function_metrics_all(spark, metrics(spark, sf_dir)).agg(
        F.sum("invocations_24h").cast("bigint").alias("invocations_24h"),
        F.sum("errors_24h").cast("bigint").alias("errors_24h"),
    )


@register(
    "health_flag",
    o.with_views("receives", "invocations")
    + _ROUTES_BODY
    + _FUNCS_BODY
    + " SELECT 'function' AS kind, function AS name, health AS flag FROM func_all "
    "UNION ALL SELECT 'queue', queue, CASE WHEN is_dlq THEN 'dlq' ELSE 'main' END || CASE WHEN has_messages THEN '+messages' ELSE '' END FROM queue_all",
)
def q_health_flag(spark, sf_dir):
    f = dash.function_metrics_all(spark, metrics(spark, sf_dir)).select(
        F.lit("function").alias("kind"), F.col("function").alias("name"), F.col("health").alias("flag")
    )
    q = dash.queue_depth_all(spark, dash.queue_depth(routes(spark, sf_dir))).select(
        F.lit("queue").alias("kind"),
        F.col("queue").alias("name"),
        F.concat(
            F.when(F.col("is_dlq"), F.lit("dlq")).otherwise(F.lit("main")),
            F.when(F.col("has_messages"), F.lit("+messages")).otherwise(F.lit("")),
        ).alias("flag"),
    )
    return f.unionByName(q)


# --- reviews -------------------------------------------------------------------
_PROJ = (
    _REVIEWS
    + """, projected AS (
  SELECT regexp_replace('REV#' || review_id, '^REV#', '') AS review_id, coalesce(repo, '') AS repo,
         cast(coalesce(pr_number, 0) AS BIGINT) AS pr_number, coalesce(pr_url, '') AS pr_url,
         coalesce(status, 'unknown') AS status, created_at AS timestamp,
         cast(coalesce(files_count, 0) AS BIGINT) AS files_count, cast(coalesce(chunks_count, 0) AS BIGINT) AS chunks_count
  FROM reviews)
"""
)


def projected(spark, sf_dir):
    return store.review_projection(reviews(spark, sf_dir))


@register(
    "review_projection",
    _PROJ + "SELECT review_id, repo, pr_number, pr_url, status, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, files_count, chunks_count FROM projected",
)
def q_review_projection(spark, sf_dir):
    return projected(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register(
    "review_display",
    _PROJ
    + """SELECT review_id, CASE WHEN repo = '' THEN '—' ELSE repo END AS repo_label,
  CASE WHEN pr_number = 0 THEN '#—' ELSE '#' || cast(pr_number AS varchar) END AS pr_label,
  CASE WHEN status = '' THEN 'pending' ELSE status END AS status_label,
  CASE WHEN status = 'complete' THEN 'info' ELSE 'warning' END AS badge,
  files_count AS files,
  CASE WHEN timestamp IS NULL THEN '—' ELSE strftime(timestamp, '%b %-d, %I:%M %p') END AS time_label
FROM projected""",
)
def q_review_display(spark, sf_dir):
    return store.review_display(projected(spark, sf_dir))


@register(
    "recent_reviews_topk",
    _PROJ
    + "SELECT review_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM projected ORDER BY timestamp DESC NULLS LAST, review_id LIMIT 50",
)
def q_recent_reviews_topk(spark, sf_dir):
    top = dash.recent_reviews(projected(spark, sf_dir))
    return top.select("review_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"))


@register(
    "review_findings_join",
    _REVIEWS + "SELECT r.review_id, k.sk, k.severity FROM reviews r LEFT JOIN keyed k USING (review_id)",
)
def q_review_findings_join(spark, sf_dir):
    # inner plus anti join: a hot review's findings are then on a side that Spark may
    # split (the null-supplying side of an outer join is not)
    f = keyed_findings(spark, sf_dir).select("review_id", "sk", "severity")
    r = reviews(spark, sf_dir).select("review_id")
    clean = r.join(reviews_with_findings(spark, sf_dir), "review_id", "left_anti")
    return r.join(f, "review_id").unionByName(clean, allowMissingColumns=True)


def reviews_with_findings(spark, sf_dir):
    return derived(spark, sf_dir, "findings_in").select("review_id").distinct()


@register(
    "clean_reviews_anti_join",
    _REVIEWS + "SELECT review_id, repo FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM findings_in f WHERE f.review_id = r.review_id)",
)
def q_clean_reviews_anti_join(spark, sf_dir):
    found = reviews_with_findings(spark, sf_dir)
    return reviews(spark, sf_dir).select("review_id", "repo").join(found, "review_id", "left_anti")


@register(
    "seen_agents",
    _FINDINGS + "SELECT review_id, count(DISTINCT agent) AS seen_agents, count(DISTINCT agent) >= 4 AS complete FROM findings_in GROUP BY review_id",
)
def q_seen_agents(spark, sf_dir):
    configure(spark)
    return dash.seen_agents(derived(spark, sf_dir, "findings_in"))


@register(
    "category_label",
    _FINDINGS
    + "SELECT ordinal, category, CASE category "
    + " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in rules.CATEGORY_LABELS.items())
    + " ELSE category END AS category_label FROM findings_in",
)
def q_category_label(spark, sf_dir):
    configure(spark)
    return dash.finding_display(derived(spark, sf_dir, "findings_in")).select("ordinal", "category", "category_label")


@register(
    "finding_location",
    _FINDINGS + "SELECT ordinal, CASE WHEN line > 0 THEN file || ':' || cast(line AS varchar) ELSE file END AS location FROM findings_in",
)
def q_finding_location(spark, sf_dir):
    configure(spark)
    return dash.finding_display(derived(spark, sf_dir, "findings_in")).select("ordinal", "location")


# --- items -----------------------------------------------------------------------
@register("key_lookup", _REVIEWS + "SELECT pk, sk FROM items WHERE pk = 'REV#rev-7'")
def q_key_lookup(spark, sf_dir):
    return store.key_lookup(stored_items(spark, sf_dir), "REV#rev-7").select("pk", "sk")


@register("sk_prefix_scan", _REVIEWS + "SELECT pk, sk FROM items WHERE starts_with(sk, 'FINDING#security#')")
def q_sk_prefix_scan(spark, sf_dir):
    return store.sk_prefix_scan(stored_items(spark, sf_dir), "FINDING#security#").select("pk", "sk")


@register(
    "status_index_query",
    _REVIEWS + "SELECT review_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM reviews WHERE status = 'complete'",
)
def q_status_index_query(spark, sf_dir):
    """The reviews of a status from the stored index, which a replay of the reviews' writes in
    two drops has kept up: the second one moves the reviews that turn out to be older."""
    configure(spark)
    path = sinks.table_path(spark, f"by-status-{uuid.uuid4().hex[:12]}")
    writes = derived(spark, sf_dir, "review_events").select("review_id", "status", "ts", "write_seq")
    drops = runner.in_drops(writes, F.col("write_seq"), 2)
    # the table's batch form takes the largest status, so that is the order of the writes here
    runner.replay(
        drops, "by-status", lambda w: status_index.index_changes(w, F.col("status")), sink=status_index.index_micro_batches(path), idle_batches=False
    )
    out = status_index.with_status(spark, path, "complete")
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_NOW_EPOCH = 1706616000  # 2024-01-30 12:00:00 UTC, the fixed "now" of the events table
# TTL of a review item: created_at + (pr_number % 60) days, so some items have
# expired by the fixed "now" and some have not.


@register(
    "ttl_expire",
    _REVIEWS
    + f"SELECT pk, sk FROM (SELECT 'REV#' || review_id AS pk, 'META' AS sk, cast(epoch(created_at) AS BIGINT) + (pr_number % 60) * 86400 AS ttl FROM reviews) WHERE ttl IS NULL OR ttl > {_NOW_EPOCH}",
)
def q_ttl_expire(spark, sf_dir):
    r = reviews(spark, sf_dir)
    ttl = (F.unix_seconds(F.col("created_at").cast("timestamp")) + (F.col("pr_number") % 60) * 86400).cast("string")
    its = store.review_items(r).join(
        r.select(F.concat(F.lit("REV#"), F.col("review_id")).alias("pk"), ttl.alias("ttl")), "pk"
    )
    its = its.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("ttl"), F.col("ttl")))).drop("ttl")
    return store.ttl_expire(its, _NOW_EPOCH).select("pk", "sk")


@register(
    "latest_item_upsert",
    o.with_views("review_events")
    + """SELECT pk, sk, event_type AS last_event FROM (
  SELECT 'REV#' || review_id AS pk, 'META' AS sk, event_type,
         row_number() OVER (PARTITION BY review_id ORDER BY ts DESC, write_seq DESC) AS rn
  FROM review_events) WHERE rn = 1""",
)
def q_latest_item_upsert(spark, sf_dir):
    configure(spark)
    writes = derived(spark, sf_dir, "review_events").select(
        F.concat(F.lit("REV#"), F.col("review_id")).alias("pk"),
        F.lit("META").alias("sk"),
        F.col("ts").alias("write_ts"),
        "write_seq",
        F.col("event_type").alias("last_event"),
    )
    return store.upsert_latest(writes).select("pk", "sk", "last_event")
