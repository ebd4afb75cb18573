"""Webhook admission: verify, filter, project, serialise, deduplicate.

All row-local except the delivery dedupe (one partial aggregation per
review key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import rules
from revlens.functions.crypto import signature_matches
from revlens.functions.text import json_fields, json_int, json_type, strict_json
from revlens.sources.landed import header

# (outcome, status code) in precedence order.
OUTCOMES = [
    ("bad_body", 500),
    ("bad_signature", 401),
    ("invalid_json", 400),
    ("ignored_event", 200),
    ("ignored_action", 200),
    ("not_an_object", 500),
    ("invalid_event", 500),
    ("topic_not_configured", 500),
    ("accepted", 200),
]


# The flat event's fields by their place in the payload: (field, object, member); the
# objects by their own place, outer ones first.
STRING_FIELDS = [
    ("action", "payload", "action"), ("repo_full_name", "repository", "full_name"), ("repo_clone_url", "repository", "clone_url"),
    ("pr_title", "pull_request", "title"), ("pr_url", "pull_request", "html_url"), ("pr_diff_url", "pull_request", "diff_url"),
    ("head_sha", "head", "sha"), ("base_ref", "base", "ref"), ("head_ref", "head", "ref"), ("sender", "sender", "login"),
]
INT_FIELDS = [("pr_number", "pull_request", "number"), ("installation_id", "installation", "id")]
_PARENTS = [
    ("repository", "payload", "repository"), ("pull_request", "payload", "pull_request"), ("sender", "payload", "sender"),
    ("installation", "payload", "installation"), ("head", "pull_request", "head"), ("base", "pull_request", "base"),
]


def _members(name: str) -> list[str]:
    return list(dict.fromkeys(m for _, of, m in [*_PARENTS, *STRING_FIELDS, *INT_FIELDS] if of == name))


def _object(name: str) -> Column:
    return F.col(f"__{name}")


def _taken_apart(df: DataFrame) -> DataFrame:
    """Adds `__<object>` for the payload and each object on the way to a field: its
    members as VARIANTs (NULL where it is absent or no object). Each object is walked
    once; all later tests and values look at single members."""
    out = df.withColumn("__payload", json_fields(F.col("payload"), _members("payload")))
    for name, of, member in _PARENTS:
        out = out.withColumn(f"__{name}", json_fields(_object(of)[member], _members(name)))
    return out


def _string(of: str, member: str) -> Column:
    return F.try_variant_get(_object(of)[member], "$", "string")


def _event_ok() -> Column:
    """Can the flat event be built: every field is absent or of its type, and every
    object on the way to one is absent or an object."""
    checks = [_object(of)[m].isNull() | _object(name).isNotNull() for name, of, m in _PARENTS]
    checks += [_object(of)[m].isNull() | (json_type(_object(of)[m]) == "STRING") for _, of, m in STRING_FIELDS]
    checks += [_object(of)[m].isNull() | json_int(_object(of)[m], "$").isNotNull() for _, of, m in INT_FIELDS]
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def admit(envelopes: DataFrame, secret: str, topic_configured: bool = True, mode: str = "skip_if_missing") -> DataFrame:
    """One outcome per request, in precedence order: body that cannot be decoded
    -> bad signature (checked on the raw bytes before any parsing) -> invalid JSON
    (text after the JSON included) -> other event -> payload not an object ->
    irrelevant action -> field of the wrong type -> no topic -> accepted.

    `envelopes` comes from `webhook_envelopes`. Adds `payload` (VARIANT), its objects
    taken apart (`__...`, for `project_webhook_event`), `outcome`, `status_code`. A body
    is parsed once and each of its objects walked once.
    """
    sig_ok = signature_matches(secret, F.col("body_bytes"), header(rules.SIGNATURE_HEADER), mode=mode)
    payload = strict_json(F.col("body_text"))
    event = F.coalesce(header(rules.EVENT_HEADER), F.lit(""))
    action = F.coalesce(_string("payload", "action"), F.lit(""))
    outcome = (
        F.when(F.col("body_text").isNull(), F.lit("bad_body"))
        .when(~F.coalesce(sig_ok, F.lit(False)), F.lit("bad_signature"))
        .when(F.col("payload").isNull(), F.lit("invalid_json"))
        .when(event != rules.REVIEWED_EVENT, F.lit("ignored_event"))
        .when(_object("payload").isNull(), F.lit("not_an_object"))
        .when(~action.isin(*rules.REVIEWED_ACTIONS), F.lit("ignored_action"))
        .when(~_event_ok(), F.lit("invalid_event"))
        .when(F.lit(not topic_configured), F.lit("topic_not_configured"))
        .otherwise(F.lit("accepted"))
    )
    codes = F.create_map(*[F.lit(x) for kv in OUTCOMES for x in kv])
    return (
        _taken_apart(envelopes.withColumn("payload", payload))
        .withColumn("outcome", outcome)
        .withColumn("status_code", F.element_at(codes, F.col("outcome")))
    )


def admission_audit(admitted: DataFrame) -> DataFrame:
    """Requests per outcome and status code (the audit table of rejected and
    accepted deliveries); one partial aggregation."""
    return admitted.groupBy("outcome", "status_code").agg(F.count(F.lit(1)).alias("requests"))


def project_webhook_event(admitted: DataFrame) -> DataFrame:
    """The 12-column flat event out of the nested payload; every missing piece
    defaults to '' (strings) or 0 (numbers)."""
    cols = {name: F.coalesce(_string(of, m), F.lit("")) for name, of, m in STRING_FIELDS}
    cols |= {name: F.coalesce(json_int(_object(of)[m], "$"), F.lit(0).cast("bigint")) for name, of, m in INT_FIELDS}
    return admitted.select("*", *[cols[name].alias(name) for name in EVENT_COLUMNS])


def rows_where(df: DataFrame, condition: Column, keep: list[str]) -> DataFrame:
    """The columns `keep` of the rows that meet `condition`, with costly columns
    evaluated once.

    A plain filter is pushed below the projections, evaluating a signature or a JSON
    parse a second time. The selection is instead made after a generator (a one-element
    array for chosen rows, none otherwise, then a filter on the generated column):
    filters on generator output stay above it."""
    row = F.struct(*[F.col(c) for c in keep])
    out = df.select(F.explode_outer(F.when(condition, F.array(row))).alias("__e"))
    return out.filter(F.col("__e").isNotNull()).select("__e.*")


def accepted_only(projected: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with outcome 'accepted', columns `keep`, evaluated in one pass."""
    return rows_where(projected, F.col("outcome") == "accepted", keep)


EVENT_COLUMNS = [
    "action", "repo_full_name", "repo_clone_url", "pr_number", "pr_title", "pr_url", "pr_diff_url",
    "head_sha", "base_ref", "head_ref", "sender", "installation_id",
]


def serialise_events(events: DataFrame, event_type: str = "pr.webhook", extra_attrs: dict[str, str] | None = None) -> DataFrame:
    """Event -> (value JSON, attributes). Attributes carry event_type
    (default 'unknown') and the repo, as message headers / partition columns."""
    attrs = {"event_type": F.lit(event_type or "unknown"), "repo": F.col("repo_full_name")}
    for k, c in (extra_attrs or {}).items():
        attrs[k] = F.lit(c)
    return events.select(
        "*",
        F.to_json(F.struct(*EVENT_COLUMNS)).alias("value"),
        F.create_map(*[x for kv in attrs.items() for x in (F.lit(kv[0]), kv[1])]).alias("attributes"),
    )


def review_key(repo: Column, pr_number: Column, head_sha: Column) -> Column:
    """Deterministic review id: re-delivery of the same PR head maps to the
    same review (the original minted a fresh random id per delivery)."""
    return F.sha2(F.concat_ws(":", repo, pr_number.cast("string"), head_sha), 256)


def dedupe_deliveries(events: DataFrame, order: str = "received_at") -> DataFrame:
    """One event per review key: the earliest delivery. A partial aggregate that compares
    `order` alone; the other columns ride along."""
    keyed = events.withColumn("review_id", review_key(F.col("repo_full_name"), F.col("pr_number"), F.col("head_sha")))
    payload = [c for c in keyed.columns if c != "review_id"]
    first = F.min_by(F.struct(*payload), F.col(order))
    return keyed.groupBy("review_id").agg(first.alias("__w"), F.count(F.lit(1)).alias("deliveries")).select(
        "review_id", *[F.col(f"__w.{c}").alias(c) for c in payload], "deliveries"
    )
