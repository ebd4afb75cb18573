"""Streaming family: each key lands its benchmark table in several drops, dealt by a hash
so that every drop spans all times and nearly all rows after the first drop are late,
drains them as a file stream (a drop a micro-batch), writes through an idempotent sink
under spark.checkpoint.dir and returns the sink's table - comparable with the batch
oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import rules
from revlens.operators import admission as adm
from revlens.operators import dashboard as dash
from revlens.plans import oracle as o
from revlens.plans.offline import no_sleep, offline_scorer_factory
from revlens.plans.q_dashboard import _FUNCS_BODY, _ROUTES_BODY, _sev_kpi_sql
from revlens.plans.q_findings import comment_tail_sql
from revlens.plans.q_ingest import _COMPLETE, _REQ
from revlens.plans.q_score import _PIPE
from revlens.plans.registry import ORACLE, register
from revlens.session import configure
from revlens.sources import landed
from revlens.sources.driver import EVENTS_NOW, WEBHOOK_SECRET, derived
from revlens.streaming import barrier, keyed, refresh, runner, sinks, snapshots

_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _fmt(col: str) -> F.Column:
    return F.date_format(F.col(col), _TS).alias(col)


# --- completion barrier -------------------------------------------------------------
@register(
    "completion_barrier",
    o.with_views("review_clock")
    + """, first AS (SELECT review_id, agent, min(ts) AS first_ts FROM review_clock WHERE agent IS NOT NULL GROUP BY ALL),
opened AS (SELECT review_id, min(first_ts) AS t0 FROM first GROUP BY review_id),
per AS (
  SELECT review_id, count(*) FILTER (WHERE first_ts <= t0 + INTERVAL 15 SECONDS) AS seen_agents,
         max(first_ts) FILTER (WHERE first_ts <= t0 + INTERVAL 15 SECONDS) AS last_in_window, min(t0) AS t0
  FROM first JOIN opened USING (review_id) GROUP BY review_id)
SELECT review_id, cast(seen_agents AS INTEGER) AS seen_agents, seen_agents >= 4 AS complete,
  strftime(CASE WHEN seen_agents >= 4 THEN last_in_window ELSE t0 + INTERVAL 15 SECONDS END, '%Y-%m-%d %H:%M:%S.%f') AS fired_at
FROM per""",
)
def q_completion_barrier(spark, sf_dir):
    return barrier.decisions(spark.read.parquet(_barrier_rows(spark, sf_dir))).select(
        "review_id", "seen_agents", "complete", _fmt("fired_at")
    )


def _barrier_rows(spark, sf_dir) -> str:
    """Folder of the barrier's rows over finding events on the per-review clock."""
    configure(spark)
    drops = runner.in_drops(derived(spark, sf_dir, "review_clock"), F.col("event_id"), 2)
    folder = runner.replay(
        drops, "barrier", lambda events: barrier.barrier_stream(events, watermark="10 seconds", event_key=F.col("event_id"))
    )
    return f"{folder}/out"


@register(
    "late_findings",
    o.with_views("review_clock")
    + "SELECT review_id, count(*) AS events, true AS once FROM review_clock WHERE agent IS NOT NULL GROUP BY review_id",
)
def q_late_findings(spark, sf_dir):
    """Where each finding event went: counted by the `fired` row of its review, or a row
    of `late_findings`; none is lost and each review fires once, whatever came late."""
    rows = spark.read.parquet(_barrier_rows(spark, sf_dir))
    return rows.where("kind <> 'amended'").groupBy("review_id").agg(
        F.sum("events").cast("bigint").alias("events"), (F.count_if(F.col("kind") == "fired") == 1).alias("once")
    )


@register(
    "emit_once_per_review",
    _COMPLETE + "SELECT DISTINCT review_id, verdict FROM parsed WHERE review_id <> ''",
)
def q_emit_once_per_review(spark, sf_dir):
    """One row per review out of its completion messages, whenever they arrive; state of
    a review goes 14 days after its last message, as its dead letters do."""
    configure(spark)

    def once(c: DataFrame) -> DataFrame:
        parsed = c.select(
            "ts", "message_id", F.coalesce(F.get_json_object("body", "$.review_id"), F.lit("")).alias("review_id"),
            F.get_json_object("body", "$.verdict").alias("verdict"),
        ).filter(F.col("review_id") != "")
        return keyed.first_per_key(parsed, "review_id", "ts", F.col("message_id"), ttl_s=14 * 86_400)

    drops = runner.in_drops(derived(spark, sf_dir, "complete_events"), F.col("message_id"), 2)
    folder = runner.replay(drops, "emit-once", once, idle_batches=False)
    return spark.read.parquet(f"{folder}/out").where("kind = 'first'").select("review_id", "verdict")


@register("message_dedupe_stream", ORACLE["message_dedupe"])
def q_message_dedupe_stream(spark, sf_dir):
    """Stream form of `message_dedupe`: all accepted deliveries come out, the earliest of
    a pull request's head stands, the others are counted."""
    from revlens.plans.q_ingest import as_envelopes
    from revlens.streaming import pipeline

    configure(spark)
    drops = runner.in_drops(derived(spark, sf_dir, "requests"), F.col("request_id"), 2)
    folder = runner.replay(
        drops, "deliveries", lambda r: pipeline.admission_stream(as_envelopes(r), WEBHOOK_SECRET, tie="request_id"), idle_batches=False
    )
    rows = spark.read.parquet(f"{folder}/out")
    standing = F.min_by(F.struct("request_id", "pr_number"), F.struct("received_at", "request_id")).alias("w")
    per = rows.groupBy("review_id").agg(standing, F.count(F.lit(1)).alias("deliveries"))
    return per.select("review_id", "w.request_id", "w.pr_number", "deliveries")


@register("dead_letter_route_stream", ORACLE["dead_letter_route"])
def q_dead_letter_route_stream(spark, sf_dir):
    """Stream form of `dead_letter_route`: state per message, the fates as they stand."""
    from revlens.streaming import pipeline

    configure(spark)
    out_dir = sinks.table_path(spark, f"dead-letters-{uuid.uuid4().hex[:12]}")
    drops = runner.in_drops(derived(spark, sf_dir, "receives"), F.col("receive_seq"), 2)
    runner.replay(drops, "fates", keyed.message_fates, sink=pipeline.dead_letter_micro_batches(out_dir), idle_batches=False)
    return snapshots.read(spark, f"{out_dir}/routes").select("message_id", "queue", "receives", "failures", "route")


def _kept_up(spark, sf_dir, only_findings: bool = False) -> str:
    """The dashboard's tables, kept up by changes over a replay; their folder."""
    configure(spark)
    out_dir = sinks.table_path(spark, f"dashboard-{uuid.uuid4().hex[:12]}")
    keys = "metric string, key string, value string, ts timestamp, tie long"
    findings = refresh.finding_writes(
        derived(spark, sf_dir, "findings_in"), F.concat_ws("/", "review_id", "agent", F.col("ordinal").cast("string")), F.col("ordinal")
    )
    writes = findings if only_findings else findings.unionByName(
        refresh.review_writes(derived(spark, sf_dir, "review_events"), F.col("write_seq"))
    )
    writes = writes.withColumn("ts", F.col("ts").cast("timestamp")).select(*[c.split()[0] for c in keys.split(", ")])
    runner.replay(runner.in_drops(writes, F.col("tie"), 2), "values", refresh.latest_values, sink=refresh.totals_micro_batches(out_dir))
    if only_findings:
        return out_dir
    receives = derived(spark, sf_dir, "receives")
    runner.replay(
        runner.in_drops(receives, F.col("receive_seq"), 2), "depths", keyed.message_fates,
        sink=refresh.totals_micro_batches(out_dir, refresh.fate_changes, "depths"), idle_batches=False,
    )
    invocations = derived(spark, sf_dir, "invocations")
    runner.replay(runner.in_drops(invocations, F.col("duration_ms"), 2), "panes", lambda s: s, sink=refresh.pane_micro_batches(out_dir))
    return out_dir


@register("periodic_refresh", o.with_views("findings_in") + " " + _sev_kpi_sql("findings_in"))
def q_periodic_refresh(spark, sf_dir):
    """Severity KPI kept up by changes, each trigger a new version of the totals that
    readers switch to as a whole. In production the trigger is
    processingTime='30 seconds'; the replay drains and stops."""
    out_dir = _kept_up(spark, sf_dir, only_findings=True)
    totals = snapshots.read(spark, f"{out_dir}/totals")
    counts = totals.agg(*[
        F.coalesce(F.sum(F.when(F.col("name") == s, F.col("value"))), F.lit(0)).cast("bigint").alias(s) for s in rules.SEVERITIES
    ])
    return counts.withColumn("total", sum((F.col(s) for s in rules.SEVERITIES), F.lit(0)).cast("bigint"))


# --- sinks of the batch pipeline ---------------------------------------------------
def _reviewed(spark, sf_dir) -> str:
    """Review the landed files of the admitted pull requests into the pipeline's own
    tables (`streaming.pipeline`) in one micro-batch; their folder."""
    from revlens.plans.q_ingest import accepted_events
    from revlens.streaming import pipeline

    configure(spark)
    out_dir = sinks.table_path(spark, f"reviewed-{uuid.uuid4().hex[:12]}")
    order = F.struct("received_at", "request_id").alias("__order")
    accepted = accepted_events(spark, sf_dir).select("request_id", F.col("received_at").cast("timestamp").alias("received_at"), *adm.EVENT_COLUMNS)
    events = adm.dedupe_deliveries(accepted.select("*", order), order="__order").select(
        "review_id", "received_at", *adm.EVENT_COLUMNS, F.lit("first").alias("kind")
    )
    review = pipeline.review_micro_batches(out_dir, _files_of(spark, sf_dir), offline_scorer_factory, sleep=no_sleep)
    review(events, 0)
    return out_dir


def _files_of(spark, sf_dir):
    landed_rows = derived(spark, sf_dir, "landed_pr_files")

    def files_of(events: DataFrame) -> DataFrame:
        named = events.select("review_id", "pr_number", "head_sha")
        return landed.pr_files(landed_rows.join(named, ["pr_number", "head_sha"]))

    return files_of


def _attr(name: str, kind: str = "string") -> F.Column:
    return F.try_element_at("attrs", F.lit(name)).cast(kind).alias(name)


def _pipe_from_requests() -> str:
    """The batch pipeline's SQL over the landed files of the admitted pull requests."""
    files = """, ev AS (
  SELECT DISTINCT sha256(repo_full_name || ':' || cast(pr_number AS varchar) || ':' || head_sha) AS review_id, pr_number, head_sha
  FROM projected),
pr_files AS (
  SELECT review_id, ordinal, json_extract_string(file_json, '$.filename') AS filename,
         json_extract_string(file_json, '$.status') AS status,
         cast(json_extract(file_json, '$.additions') AS BIGINT) AS additions,
         cast(json_extract(file_json, '$.deletions') AS BIGINT) AS deletions,
         coalesce(json_extract_string(file_json, '$.patch'), '') AS patch,
         json_extract_string(file_json, '$.previous_filename') AS previous_filename
  FROM landed_pr_files JOIN ev USING (pr_number, head_sha))"""
    head = o.with_views("pr_files")
    assert _PIPE.startswith(head)
    return _REQ.rstrip() + ",\n" + o.views_cte("landed_pr_files") + files + _PIPE[len(head):]


_FIRST = """, firsts AS (
  SELECT sha256(repo_full_name || ':' || cast(pr_number AS varchar) || ':' || head_sha) AS review_id, * FROM projected
  QUALIFY row_number() OVER (PARTITION BY repo_full_name, pr_number, head_sha ORDER BY received_at, request_id) = 1)
"""


@register(
    "write_reviews",
    _pipe_from_requests().rstrip() + _FIRST
    + """, stats AS (SELECT review_id, count(*) FILTER (WHERE NOT is_generated) AS files_count FROM changes GROUP BY review_id),
nchunks AS (SELECT review_id, max(total_chunks) AS chunks_count FROM assigned GROUP BY review_id)
SELECT 'REV#' || s.review_id AS pk, 'META' AS sk, 'parsing_complete' AS status, f.repo_full_name AS repo, f.pr_number, f.pr_url, f.sender,
       f.head_sha, strftime(f.received_at, '%Y-%m-%d %H:%M:%S') AS created_at, files_count, coalesce(chunks_count, 0) AS chunks_count,
       cast(v.latency_ms AS BIGINT) AS latency_ms
FROM stats s JOIN firsts f USING (review_id) JOIN verdicts v USING (review_id) LEFT JOIN nchunks USING (review_id)""",
)
def q_write_reviews(spark, sf_dir):
    items = snapshots.read(spark, f"{_reviewed(spark, sf_dir)}/items").where("sk = 'META'")
    return items.select(
        "pk", "sk", *[_attr(c) for c in ("status", "repo", "pr_url", "sender", "head_sha")],
        F.date_format(_attr("created_at", "timestamp"), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        *[_attr(c, "bigint") for c in ("pr_number", "files_count", "chunks_count", "latency_ms")],
    )


@register(
    "write_findings",
    _pipe_from_requests().rstrip() + _FIRST
    + """SELECT 'REV#' || k.review_id AS pk, sk, severity, category, file, line, message, suggestion, agent, f.repo_full_name AS repo, f.pr_number
FROM keyed k JOIN firsts f USING (review_id)""",
)
def q_write_findings(spark, sf_dir):
    items = snapshots.read(spark, f"{_reviewed(spark, sf_dir)}/items").where("sk <> 'META'")
    text = ("severity", "category", "file", "message", "suggestion", "agent", "repo")
    return items.select("pk", "sk", *[_attr(c) for c in text], *[_attr(c, "bigint") for c in ("line", "pr_number")])


@register(
    "write_comments",
    _pipe_from_requests().rstrip()
    + comment_tail_sql().replace(
        "SELECT v.review_id, verdict,",
        "SELECT v.review_id, verdict, CASE WHEN verdict = 'request_changes' THEN 'failure' ELSE 'success' END AS state,",
    ),
)
def q_write_comments(spark, sf_dir):
    out_dir = _triggered(spark, sf_dir)
    return snapshots.read(spark, f"{out_dir}/comments").select("review_id", "verdict", "state", "comment")


def _triggered(spark, sf_dir):
    """Reviews reviewed and triggered, the trigger micro-batch replayed and, as after a
    lost checkpoint, sent again as the next one."""
    from revlens.streaming import pipeline

    out_dir = _reviewed(spark, sf_dir)
    reported = spark.read.parquet(f"{out_dir}/review_events").drop("batch_id")
    fired = barrier.barrier_batch(reported).select(
        "review_id", F.lit("fired").alias("kind"), F.lit(0).alias("version"), "seen_agents", "complete", "fired_at", F.lit(1).cast("bigint").alias("events"),
        F.lit(None).cast("string").alias("agent"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("event_key"),
    )
    trigger = pipeline.trigger_micro_batches(out_dir)
    for batch_id in (0, 0, 1):
        trigger(fired, batch_id)
    return out_dir


@register(
    "publish_complete",
    _pipe_from_requests()
    + """SELECT review_id, to_json({'review_id': review_id, 'verdict': verdict, 'total_findings': total_findings,
  'latency_ms': latency_ms})::VARCHAR AS value, 'review.complete' AS event_type, 1 AS copies FROM verdicts""",
)
def q_publish_complete(spark, sf_dir):
    """The outbox after a forced replay: each message is there once."""
    out_dir = _triggered(spark, sf_dir)
    published = spark.read.parquet(f"{out_dir}/complete").groupBy("review_id", F.col("body").alias("value"), "event_type")
    return published.agg(F.count(F.lit(1)).cast("int").alias("copies"))


# --- streaming pipeline --------------------------------------------------------------
def _connected(spark, sf_dir) -> str:
    """Run the connected pipeline over a replay of the webhook requests, in drops that
    each span all days; the folder of its tables."""
    from revlens.plans.q_ingest import as_envelopes
    from revlens.streaming import pipeline

    configure(spark)
    out_dir = sinks.table_path(spark, f"connected-{uuid.uuid4().hex[:12]}")
    requests = derived(spark, sf_dir, "requests").withColumn("received_at", F.col("received_at").cast("timestamp"))
    runner.replay(
        runner.in_drops(requests, F.col("request_id"), 2), "admission",
        lambda r: pipeline.admission_stream(as_envelopes(r), WEBHOOK_SECRET),
        sink=pipeline.review_micro_batches(out_dir, _files_of(spark, sf_dir), offline_scorer_factory, sleep=no_sleep), idle_batches=False,
    )
    # the replay ends here: a tick a day later lets the clock pass every deadline
    reported = spark.read.parquet(f"{out_dir}/review_events")
    tick = reported.agg((F.max("ts") + F.make_dt_interval(days=F.lit(1))).alias("ts")).select(
        *[(F.col("ts") if f.name == "ts" else F.lit("tick") if f.name == "review_id" else F.lit(None).cast(f.dataType)).alias(f.name)
          for f in reported.drop("batch_id").schema]
    )
    sinks.write_batch(tick, f"{out_dir}/review_events", 1 << 30)
    stream = spark.readStream.schema(reported.schema).parquet(f"{out_dir}/review_events")
    runner.run(barrier.barrier_stream(stream, watermark="10 seconds"), "triggers", sink=pipeline.trigger_micro_batches(out_dir))
    messages = spark.readStream.schema("review_id string, body string, ts timestamp, message_id string, sequence long, batch_id int, event_type string")
    runner.run(messages.parquet(f"{out_dir}/complete"), "learning", sink=pipeline.learning_micro_batches(out_dir))
    return out_dir


@register(
    "review_pipeline_stream",
    _pipe_from_requests().rstrip()
    + comment_tail_sql().replace(
        "SELECT v.review_id, verdict,",
        "SELECT v.review_id, verdict, n_critical, n_critical + n_warning + n_info AS total_findings, 'LEARNING#' || v.review_id AS learning,",
    ),
)
def q_review_pipeline_stream(spark, sf_dir):
    """Webhook requests stream in and are admitted and deduplicated; each event's landed
    files are reviewed; the barrier triggers comment and completion message; completions
    become learning records. The rows join what the last tables hold."""
    out_dir = _connected(spark, sf_dir)
    comments, learned = (snapshots.read(spark, f"{out_dir}/{table}") for table in ("comments", "learnings"))
    ids = learned.select(F.col("attrs")["review_id"].alias("review_id"), F.col("sk").alias("learning"))
    return comments.join(ids, "review_id").select(
        "review_id", "verdict", "n_critical", "total_findings", "learning", "comment"
    )


# --- dashboard ------------------------------------------------------------------------
_OVERVIEW_SQL = (
    o.with_views("findings_in", "review_events", "receives", "invocations")
    + _ROUTES_BODY
    + _FUNCS_BODY
    + """, sev AS ("""
    + _sev_kpi_sql("findings_in")
    + """),
revs AS (SELECT count(DISTINCT review_id) AS total_reviews FROM review_events)
SELECT total_reviews, total AS total_findings, critical, warning, info,
  (SELECT string_agg(queue || '=' || depth, ',' ORDER BY queue) FROM queue_all) AS queues,
  (SELECT string_agg(function || '=' || invocations_24h, ',' ORDER BY function) FROM func_all) AS invocations,
  (SELECT string_agg(function || '=' || errors_24h, ',' ORDER BY function) FROM func_all) AS errors
FROM sev, revs"""
)


def _overview(spark, sf_dir) -> DataFrame:
    from revlens.plans.q_dashboard import metrics, reviews, routes
    from revlens.sources import store

    sev = dash.severity_kpi(derived(spark, sf_dir, "findings_in"))
    # only META items count as reviews, so the finding items need not be built
    revs = dash.review_count_kpi(store.review_items(reviews(spark, sf_dir)))
    qd = dash.queue_depth_all(spark, dash.queue_depth(routes(spark, sf_dir)))
    fm = dash.function_metrics_all(spark, metrics(spark, sf_dir))
    return _listed(dash.overview(sev, revs, qd, fm))


def _listed(ov: DataFrame) -> DataFrame:
    """An overview row with its maps as text."""
    def listed(name: str):
        pairs = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(pairs, ",").alias(name)

    return ov.select(
        "total_reviews", "total_findings", *rules.SEVERITIES, listed("queues"), listed("invocations"), listed("errors")
    )


@register("overview_stream", _OVERVIEW_SQL)
def q_overview_stream(spark, sf_dir):
    """The overview kept up by changes of findings, reviews, messages and invocations."""
    return _listed(refresh.overview(spark, _kept_up(spark, sf_dir), EVENTS_NOW))


@register("overview_kpi", _OVERVIEW_SQL)
def q_overview_kpi(spark, sf_dir):
    configure(spark)
    return _overview(spark, sf_dir)


_KPIS = ("total_reviews", "total_findings", "critical", "warning", "info", "queues", "invocations", "errors")


@register(
    "dashboard_refresh",
    "SELECT 'kpi' AS kind, key, value FROM (UNPIVOT (SELECT "
    + ", ".join(f"cast({k} AS VARCHAR) AS {k}" for k in _KPIS)
    + f" FROM ({_OVERVIEW_SQL})) ON {', '.join(_KPIS)} INTO NAME key VALUE value)"
    + f" UNION ALL SELECT 'review', review_id, timestamp FROM ({ORACLE['recent_reviews_topk']})"
    + f" UNION ALL SELECT 'finding', review_id || '/' || sk, cast(sorted_position AS VARCHAR) FROM ({ORACLE['findings_sorted']})",
)
def q_dashboard_refresh(spark, sf_dir):
    """All that one refresh shows, stacked: the overview's figures, the latest reviews
    and the findings at their places; `periodic_refresh` is the 30 s streaming form."""
    from revlens.plans.q_dashboard import q_recent_reviews_topk
    from revlens.plans.q_findings import q_findings_sorted

    configure(spark)
    kpis = _overview(spark, sf_dir).select(F.explode(F.create_map(
        *[x for k in _KPIS for x in (F.lit(k), F.col(k).cast("string"))]
    )).alias("key", "value"))
    reviews = q_recent_reviews_topk(spark, sf_dir).select(F.col("review_id").alias("key"), F.col("timestamp").alias("value"))
    findings = q_findings_sorted(spark, sf_dir).select(
        F.concat("review_id", F.lit("/"), "sk").alias("key"), F.col("sorted_position").cast("string").alias("value")
    )
    parts = [df.select(F.lit(kind).alias("kind"), "key", "value") for kind, df in (("kpi", kpis), ("review", reviews), ("finding", findings))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
