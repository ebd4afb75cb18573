"""Ingestion family: envelopes, signatures, admission, projection, messages,
landed hosting-API objects, typed decoding, completion messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import rules
from revlens.functions.crypto import padded_keys, signature_matches
from revlens.functions.text import strict_json
from revlens.operators import admission as adm
from revlens.operators import dashboard as dash
from revlens.operators.ordering import first_by_order
from revlens.plans import oracle as o
from revlens.plans.q_dashboard import _ROUTES
from revlens.plans.registry import register
from revlens.session import configure
from revlens.sources import landed, store
from revlens.sources.driver import EVENTS_NOW, WEBHOOK_SECRET, derived


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows as landed envelopes (mixed-case header names)."""
    configure(spark)
    return landed.webhook_envelopes(as_envelopes(derived(spark, sf_dir, "requests")))


def as_envelopes(r: DataFrame) -> DataFrame:
    """Request rows (of a table or a stream) as landed, with mixed-case header names."""
    headers = F.map_filter(
        F.create_map(
            F.lit("X-GitHub-Event"), F.col("header_event"),
            F.lit("Content-Type"), F.lit("application/json"),
            F.lit("X-Hub-Signature-256"), F.col("header_signature"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return r.select("request_id", "received_at", headers.alias("headers"), "body", F.col("is_base64").alias("isBase64Encoded"))


def admitted(spark, sf_dir) -> DataFrame:
    return adm.admit(envelopes(spark, sf_dir), WEBHOOK_SECRET)


def accepted_events(spark, sf_dir) -> DataFrame:
    """Accepted, projected events, admission evaluated once per request
    (`admission.accepted_only`)."""
    projected = adm.project_webhook_event(admitted(spark, sf_dir))
    return adm.accepted_only(projected, ["request_id", "received_at", "body_text", "outcome", *adm.EVENT_COLUMNS])


# --- oracle -------------------------------------------------------------------------
def _hmac_sql(bytes_expr: str) -> str:
    ipad, opad = padded_keys(WEBHOOK_SECRET)
    return f"'sha256=' || sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || {bytes_expr})))"


_REQ = (
    o.with_views("requests")
    + f""", env AS (
  SELECT request_id, received_at, header_event, header_signature,
         CASE WHEN is_base64 THEN TRY(from_base64(body)) ELSE encode(body) END AS body_bytes, body
  FROM requests),
env2 AS (
  SELECT *, TRY(decode(body_bytes)) AS body_text, coalesce(TRY(decode(body_bytes)), body) AS queue_text,
         {_hmac_sql('body_bytes')} AS expected FROM env),
checked AS (
  SELECT *, coalesce(header_signature = expected, false) AS strict_ok,
         header_signature IS NULL OR header_signature = '' OR coalesce(header_signature = expected, false) AS lenient_ok,
         coalesce(json_valid(body_text), false) AS is_json
  FROM env2),
admitted AS (
  SELECT *, CASE WHEN body_text IS NULL THEN 'bad_body' WHEN NOT lenient_ok THEN 'bad_signature' WHEN NOT is_json THEN 'invalid_json'
                 WHEN coalesce(header_event, '') <> 'pull_request' THEN 'ignored_event'
                 WHEN json_type(body_text) <> 'OBJECT' THEN 'not_an_object'
                 WHEN coalesce(json_extract_string(body_text, '$.action'), '') NOT IN ('opened', 'synchronize', 'reopened') THEN 'ignored_action'
                 WHEN json_type(body_text, '$.pull_request.number') IS NOT NULL
                      AND try_cast(json_extract_string(body_text, '$.pull_request.number') AS BIGINT) IS NULL THEN 'invalid_event'
                 ELSE 'accepted' END AS outcome
  FROM checked),
projected AS (
  SELECT request_id, received_at, body_text,
    coalesce(json_extract_string(body_text, '$.action'), '') AS action,
    coalesce(json_extract_string(body_text, '$.repository.full_name'), '') AS repo_full_name,
    coalesce(json_extract_string(body_text, '$.repository.clone_url'), '') AS repo_clone_url,
    coalesce(cast(json_extract(body_text, '$.pull_request.number') AS BIGINT), 0) AS pr_number,
    coalesce(json_extract_string(body_text, '$.pull_request.title'), '') AS pr_title,
    coalesce(json_extract_string(body_text, '$.pull_request.html_url'), '') AS pr_url,
    coalesce(json_extract_string(body_text, '$.pull_request.diff_url'), '') AS pr_diff_url,
    coalesce(json_extract_string(body_text, '$.pull_request.head.sha'), '') AS head_sha,
    coalesce(json_extract_string(body_text, '$.pull_request.base.ref'), '') AS base_ref,
    coalesce(json_extract_string(body_text, '$.pull_request.head.ref'), '') AS head_ref,
    coalesce(json_extract_string(body_text, '$.sender.login'), '') AS sender,
    coalesce(cast(json_extract(body_text, '$.installation.id') AS BIGINT), 0) AS installation_id
  FROM admitted WHERE outcome = 'accepted')
"""
)


@register(
    "webhook_envelope_scan",
    _REQ + "SELECT request_id, header_event AS event, octet_length(body_bytes) AS body_bytes, md5(body_bytes) AS body_md5, body_text IS NULL AS unreadable FROM env2",
)
def q_webhook_envelope_scan(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    return e.select(
        "request_id", landed.header(rules.EVENT_HEADER).alias("event"),
        F.octet_length("body_bytes").cast("bigint").alias("body_bytes"), F.md5("body_bytes").alias("body_md5"),
        F.col("body_text").isNull().alias("unreadable"),
    )


@register("signature_verify", _REQ + "SELECT request_id, strict_ok, lenient_ok FROM checked")
def q_signature_verify(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    sig = landed.header(rules.SIGNATURE_HEADER)
    return e.select(
        "request_id",
        signature_matches(WEBHOOK_SECRET, F.col("body_bytes"), sig, "strict").alias("strict_ok"),
        signature_matches(WEBHOOK_SECRET, F.col("body_bytes"), sig, "skip_if_missing").alias("lenient_ok"),
    )


@register("event_type_filter", _REQ + "SELECT request_id FROM env2 WHERE coalesce(header_event, '') = 'pull_request'")
def q_event_type_filter(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    return e.filter(F.coalesce(landed.header(rules.EVENT_HEADER), F.lit("")) == rules.REVIEWED_EVENT).select("request_id")


@register(
    "action_filter",
    _REQ + "SELECT request_id, json_extract_string(body_text, '$.action') AS action FROM checked WHERE is_json "
    "AND json_extract_string(body_text, '$.action') IN ('opened', 'synchronize', 'reopened')",
)
def q_action_filter(spark, sf_dir):
    e = envelopes(spark, sf_dir).withColumn("payload", strict_json(F.col("body_text")))
    e = e.withColumn("action", F.try_variant_get("payload", "$.action", "string"))
    return adm.rows_where(e, F.col("action").isin(*rules.REVIEWED_ACTIONS), ["request_id", "action"])


@register(
    "admission_route",
    _REQ
    + """SELECT request_id, outcome, CASE outcome WHEN 'bad_signature' THEN 401 WHEN 'invalid_json' THEN 400
  WHEN 'bad_body' THEN 500 WHEN 'invalid_event' THEN 500 WHEN 'not_an_object' THEN 500 WHEN 'topic_not_configured' THEN 500 ELSE 200 END AS status_code FROM admitted""",
)
def q_admission_route(spark, sf_dir):
    return admitted(spark, sf_dir).select("request_id", "outcome", F.col("status_code").cast("int"))


@register("webhook_project", _REQ + "SELECT * EXCLUDE (received_at, body_text) FROM projected")
def q_webhook_project(spark, sf_dir):
    return accepted_events(spark, sf_dir).select("request_id", *adm.EVENT_COLUMNS)


@register(
    "event_serialise",
    _REQ
    + """SELECT request_id, to_json({'action': action, 'repo_full_name': repo_full_name, 'repo_clone_url': repo_clone_url,
  'pr_number': pr_number, 'pr_title': pr_title, 'pr_url': pr_url, 'pr_diff_url': pr_diff_url, 'head_sha': head_sha,
  'base_ref': base_ref, 'head_ref': head_ref, 'sender': sender, 'installation_id': installation_id})::VARCHAR AS value,
  'pr.webhook' AS event_type, repo_full_name AS repo FROM projected""",
)
def q_event_serialise(spark, sf_dir):
    s = adm.serialise_events(accepted_events(spark, sf_dir))
    return s.select(
        "request_id", "value", F.col("attributes")["event_type"].alias("event_type"), F.col("attributes")["repo"].alias("repo")
    )


@register(
    "message_dedupe",
    _REQ
    + """SELECT review_id, request_id, pr_number, deliveries FROM (
  SELECT sha256(repo_full_name || ':' || cast(pr_number AS varchar) || ':' || head_sha) AS review_id, request_id, pr_number,
         count(*) OVER (PARTITION BY repo_full_name, pr_number, head_sha) AS deliveries,
         row_number() OVER (PARTITION BY repo_full_name, pr_number, head_sha ORDER BY received_at, request_id) AS rn
  FROM projected) WHERE rn = 1""",
)
def q_message_dedupe(spark, sf_dir):
    ev = accepted_events(spark, sf_dir).select("request_id", "received_at", *adm.EVENT_COLUMNS)
    keyed = ev.withColumn("__order", F.struct("received_at", "request_id"))
    d = adm.dedupe_deliveries(keyed, order="__order")
    return d.select("review_id", "request_id", "pr_number", "deliveries")


# --- queue messages ---------------------------------------------------------------
_WRAP = (
    "CASE WHEN request_id % 2 = 0 THEN '{\"Type\": \"Notification\", \"Message\": ' || "
    "chr(34) || replace(replace(queue_text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || chr(34) || '}' "
    "ELSE queue_text END"
)


def queue_texts(spark, sf_dir) -> DataFrame:
    """Queue bodies: the requests' texts; of a body that cannot be decoded, as landed."""
    return envelopes(spark, sf_dir).withColumn("queue_text", F.coalesce("body_text", "body"))


def _wrapped(spark, sf_dir) -> DataFrame:
    e = queue_texts(spark, sf_dir)
    esc = F.regexp_replace(F.regexp_replace("queue_text", r"\\", r"\\\\"), '"', '\\\\"')
    body = F.when(
        F.col("request_id") % 2 == 0, F.concat(F.lit('{"Type": "Notification", "Message": "'), esc, F.lit('"}'))
    ).otherwise(F.col("queue_text"))
    return e.select("request_id", "queue_text", body.alias("queue_body"), (F.col("request_id") % 2 == 0).alias("enveloped"))


@register(
    "queue_scan",
    _REQ
    + """SELECT request_id, NOT json_valid(queue_text) AS is_raw,
  CASE WHEN json_valid(queue_text) THEN json_extract_string(queue_text, '$.action') ELSE json_extract_string(to_json({'raw': queue_text}), '$.raw') END AS first_field
FROM env2""",
)
def q_queue_scan(spark, sf_dir):
    m = landed.queue_messages(queue_texts(spark, sf_dir), body="queue_text")
    first = F.when(F.col("is_raw"), F.variant_get("payload", "$.raw", "string")).otherwise(
        F.variant_get("payload", "$.action", "string")
    )
    return m.select("request_id", "is_raw", first.alias("first_field"))


@register(
    "envelope_unwrap",
    _REQ
    + f""", wrapped AS (SELECT request_id, {_WRAP} AS queue_body FROM env2)
SELECT request_id, md5(coalesce(CASE WHEN json_valid(queue_body) THEN json_extract_string(queue_body, '$.Message') END, queue_body)) AS payload_md5 FROM wrapped""",
)
def q_envelope_unwrap(spark, sf_dir):
    w = _wrapped(spark, sf_dir)
    return w.select("request_id", F.md5(landed.unwrap_envelope(F.col("queue_body"))).alias("payload_md5"))


@register(
    "raw_vs_enveloped_route",
    _REQ
    + f""", wrapped AS (SELECT request_id, {_WRAP} AS queue_body, request_id % 2 = 0 AS enveloped FROM env2)
SELECT request_id, CASE WHEN enveloped THEN 'review-topic' ELSE 'pr-webhook' END AS source,
  md5(CASE WHEN enveloped THEN coalesce(json_extract_string(queue_body, '$.Message'), queue_body) ELSE queue_body END) AS payload_md5
FROM wrapped""",
)
def q_raw_vs_enveloped_route(spark, sf_dir):
    w = _wrapped(spark, sf_dir)
    return w.select(
        "request_id",
        F.when(F.col("enveloped"), F.lit("review-topic")).otherwise(F.lit("pr-webhook")).alias("source"),
        F.md5(landed.route_payload(F.col("queue_body"), F.col("enveloped"))).alias("payload_md5"),
    )


# --- landed hosting-API objects --------------------------------------------------
@register(
    "pr_files_scan",
    o.with_views("pr_file_json")
    + """ SELECT review_id, ordinal, json_extract_string(file_json, '$.filename') AS filename,
  json_extract_string(file_json, '$.status') AS status,
  cast(coalesce(json_extract(file_json, '$.additions'), '0') AS BIGINT) AS additions,
  cast(coalesce(json_extract(file_json, '$.deletions'), '0') AS BIGINT) AS deletions,
  md5(coalesce(json_extract_string(file_json, '$.patch'), '')) AS patch_md5,
  json_extract_string(file_json, '$.previous_filename') AS previous_filename
FROM pr_file_json""",
)
def q_pr_files_scan(spark, sf_dir):
    configure(spark)
    f = landed.pr_files(derived(spark, sf_dir, "pr_file_json"))
    return f.select(
        "review_id", "ordinal", "filename", "status", "additions", "deletions", F.md5("patch").alias("patch_md5"),
        "previous_filename",
    )


@register(
    "pr_metadata_scan",
    o.with_views("pr_meta_json")
    + """ SELECT pr_number, json_extract_string(meta_json, '$.title') AS title,
  coalesce(json_extract_string(meta_json, '$.body'), '') AS body,
  json_extract_string(meta_json, '$.head.sha') AS head_sha, json_extract_string(meta_json, '$.user.login') AS user,
  array_to_string(json_extract_string(meta_json, '$.labels[*].name'), ',') AS labels,
  json_extract_string(meta_json, '$.updated_at') AS updated_at
FROM pr_meta_json""",
)
def q_pr_metadata_scan(spark, sf_dir):
    configure(spark)
    m = landed.pr_metadata(derived(spark, sf_dir, "pr_meta_json"))
    return m.select("pr_number", "title", "body", "head_sha", "user", F.array_join("labels", ",").alias("labels"), "updated_at")


# One nested event per row, as text that both engines build alike: a parsed pull request
# of one file (every seventh without a sender) and a review of one finding.
_PARSED_JSON = """'{"review_id": "' || review_id || '", "repo_full_name": "o/r", "pr_number": 1, "pr_title": "", "pr_url": "", "head_sha": "s", "base_ref": "b", "head_ref": "h"' ||
  CASE WHEN ordinal % 7 = 0 THEN '' ELSE ', "sender": "me"' END || ', "files": [{"path": "' || filename || '", "language": "x", "status": "' || status ||
  '", "additions": ' || cast(additions as string) || '}], "stats": {"total_files": 1, "languages": ["x"]}}'"""
_REVIEW_JSON = """'{"review_id": "' || review_id || '", "repo_full_name": "' || repo || '", "pr_number": ' || cast(pr_number as string) ||
  ', "pr_url": "", "head_sha": "s", "agent_meta": {"agent": "' || agent || '"}, "findings": [{"severity": "' || severity || '", "category": "' || category ||
  '", "file": "' || file || '", "line": ' || cast(line as string) || ', "message": "' || message || '"}]}'"""
_PARSED_TEXT = f"SELECT ordinal, {_PARSED_JSON} AS text FROM pr_files"
_REVIEW_TEXT = f"SELECT ordinal, {_REVIEW_JSON} AS text FROM findings_in"


def _typed_sql() -> str:
    checks = []
    for name, typ, default in landed.WEBHOOK_EVENT_FIELDS:
        t = f"json_type(text, '$.{name}')"
        if typ == "string":
            ok = f"coalesce({t} = 'VARCHAR', false)"
        else:
            ok = (f"coalesce({t} IN ('BIGINT', 'UBIGINT') OR ({t} = 'VARCHAR' AND "
                  f"regexp_full_match(json_extract_string(text, '$.{name}'), '\\s*[+-]?[0-9]+\\s*')), false)")
        if default is not None:
            ok = f"({t} IS NULL OR {ok})"
        checks.append(f"CASE WHEN NOT {ok} THEN 1 ELSE 0 END")
    n_bad = " + ".join(checks)
    return (
        _REQ.rstrip() + ",\n" + o.views_cte("pr_files", "findings_in")
        + f""", inputs AS (
  SELECT request_id, 'flat' AS kind, to_json({{'action': action, 'repo_full_name': repo_full_name, 'repo_clone_url': repo_clone_url,
    'pr_number': pr_number, 'pr_title': pr_title, 'pr_url': pr_url, 'pr_diff_url': pr_diff_url, 'head_sha': head_sha,
    'base_ref': base_ref, 'head_ref': head_ref, 'sender': sender, 'installation_id': installation_id}})::VARCHAR AS text
  FROM projected
  UNION ALL
  SELECT request_id, 'nested', body_text FROM projected)
SELECT request_id, kind, CASE WHEN json_type(text) = 'OBJECT' THEN {n_bad} ELSE 1 END AS n_violations,
       CASE WHEN json_type(text) = 'OBJECT' THEN ({n_bad}) = 0 ELSE false END AS valid
FROM inputs
UNION ALL
SELECT request_id, kind, bad, bad = 0 FROM (
  SELECT ordinal AS request_id, 'parsed' AS kind,
    CASE WHEN json_extract_string(text, '$.files[0].status') IN ('added', 'modified', 'deleted', 'renamed') THEN 0 ELSE 1 END
    + CASE WHEN json_type(text, '$.sender') = 'VARCHAR' THEN 0 ELSE 1 END AS bad
  FROM ({_PARSED_TEXT})
  UNION ALL
  SELECT ordinal, 'review', CASE WHEN json_extract_string(text, '$.findings[0].severity') IN ('critical', 'warning', 'info') THEN 0 ELSE 1 END
  FROM ({_REVIEW_TEXT}))"""
    )


@register("typed_event_parse", _typed_sql())
def q_typed_event_parse(spark, sf_dir):
    """Each event ends in the table of its model or in its quarantine; both are read back."""
    ev = adm.serialise_events(accepted_events(spark, sf_dir))
    texts = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("text")) for kind, c in (("flat", "value"), ("nested", "body_text"))]
    webhook = ev.select("request_id", F.inline(F.array(*texts)))  # a request is admitted once for both of its texts
    parsed = derived(spark, sf_dir, "pr_files").select(F.col("ordinal").alias("request_id"), F.lit("parsed").alias("kind"), F.expr(_PARSED_JSON).alias("text"))
    reviews = derived(spark, sf_dir, "findings_in").select(F.col("ordinal").alias("request_id"), F.lit("review").alias("kind"), F.expr(_REVIEW_JSON).alias("text"))
    from revlens.streaming import quarantine, sinks, snapshots

    keys, out = ["request_id", "kind"], None
    folder = sinks.table_path(spark, f"typed-{uuid.uuid4().hex[:12]}")
    for rows, model in ((webhook, "webhook"), (parsed, "parsed"), (reviews, "review")):
        quarantine.typed_micro_batches(f"{folder}/{model}", landed.EVENT_MODELS[model], keys)(rows, 0)
        good = snapshots.read(spark, f"{folder}/{model}/events").select(*keys, F.lit(0).alias("n_violations"), F.lit(True).alias("valid"))
        bad = quarantine.held(spark, f"{folder}/{model}").select(*keys, "n_violations", F.lit(False).alias("valid"))
        out = good.unionByName(bad) if out is None else out.unionByName(good).unionByName(bad)
    return out


# --- completion messages ----------------------------------------------------------
def complete_events(spark, sf_dir) -> DataFrame:
    configure(spark)
    c = derived(spark, sf_dir, "complete_events")
    payload = F.try_parse_json(landed.unwrap_envelope(F.col("body")))
    return c.select(
        "message_id", "ts",
        F.coalesce(F.variant_get(payload, "$.review_id", "string"), F.lit("")).alias("review_id"),
        F.variant_get(payload, "$.verdict", "string").alias("verdict"),
    )


_COMPLETE = (
    o.with_views("complete_events")
    + """, parsed AS (
  SELECT message_id, ts, coalesce(json_extract_string(body, '$.review_id'), '') AS review_id,
         json_extract_string(body, '$.verdict') AS verdict FROM complete_events)
"""
)


@register("missing_review_id_filter", _COMPLETE + "SELECT message_id, review_id FROM parsed WHERE review_id <> ''")
def q_missing_review_id_filter(spark, sf_dir):
    kept, _skipped = store.skip_missing_review_id(complete_events(spark, sf_dir))
    return kept.select("message_id", "review_id")


@register(
    "learning_record",
    _COMPLETE
    + """SELECT 'TEAM#global' AS pk, 'LEARNING#' || review_id AS sk, verdict, 'false' AS patterns_extracted FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ts DESC, message_id DESC) AS rn
  FROM parsed WHERE review_id <> '') WHERE rn = 1""",
)
def q_learning_record(spark, sf_dir):
    c = complete_events(spark, sf_dir)
    writes = c.filter(F.col("review_id") != "").select(
        "review_id", "verdict", F.col("ts").alias("write_ts"), F.col("message_id").alias("write_seq")
    )
    latest = first_by_order(writes, ["review_id"], ["write_ts", "write_seq"], descending=True)
    rec = store.learning_items(latest)
    return rec.select("pk", "sk", F.col("attrs")["verdict"].alias("verdict"), F.col("attrs")["patterns_extracted"].alias("patterns_extracted"))


# --- queue retention and redelivery ---------------------------------------------------
@register(
    "retention_expire",
    _ROUTES
    + """SELECT message_id, route FROM routed
WHERE (route = 'dead' AND last_received_at > TIMESTAMP '"""
    + EVENTS_NOW
    + """' - INTERVAL 14 DAYS) OR (route <> 'dead' AND first_received_at > TIMESTAMP '"""
    + EVENTS_NOW
    + """' - INTERVAL 4 DAYS)""",
)
def q_retention_expire(spark, sf_dir):
    from revlens.operators.messages import retained

    configure(spark)
    return retained(dash.message_routes(derived(spark, sf_dir, "receives")), EVENTS_NOW).select("message_id", "route")


@register(
    "visibility_redelivery",
    o.with_views("receives")
    + """ SELECT message_id, receive_seq,
  epoch_us(lead(received_at) OVER w) - epoch_us(received_at) AS gap_us,
  CASE WHEN lead(received_at) OVER w IS NULL THEN 'last'
       WHEN epoch_us(lead(received_at) OVER w) - epoch_us(received_at)
            >= CASE WHEN queue = 'learn-queue' THEN 120000000 ELSE 300000000 END THEN 'after_timeout' ELSE 'early' END AS kind
FROM receives WINDOW w AS (PARTITION BY message_id ORDER BY received_at, receive_seq)""",
)
def q_visibility_redelivery(spark, sf_dir):
    from revlens.operators.messages import redeliveries

    configure(spark)
    return redeliveries(derived(spark, sf_dir, "receives")).select("message_id", "receive_seq", "gap_us", "kind")
