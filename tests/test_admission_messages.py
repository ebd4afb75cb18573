"""Webhook admission outcomes, delivery dedupe, message fates."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from revlens.operators import admission as adm
from revlens.operators import dashboard as dash
from revlens.sources import landed

SECRET = "hook-secret"
PAYLOAD = {
    "action": "opened", "number": 7,
    "pull_request": {"number": 7, "title": "T", "html_url": "u", "diff_url": "d",
                     "head": {"sha": "abc", "ref": "feat"}, "base": {"ref": "main"}},
    "repository": {"full_name": "o/r", "clone_url": "c"}, "sender": {"login": "me"}, "installation": {"id": 9},
}


def sig(body):
    return "sha256=" + hmac.new(SECRET.encode(), body.encode(), hashlib.sha256).hexdigest()


def envelope(event="pull_request", body=None, signature="good", b64=False):
    body = json.dumps(PAYLOAD) if body is None else body
    headers = {"X-GitHub-Event": event, "Content-Type": "application/json"}
    if signature == "good":
        headers["X-Hub-Signature-256"] = sig(body)
    elif signature == "bad":
        headers["X-Hub-Signature-256"] = "sha256=" + "0" * 64
    return (headers, base64.b64encode(body.encode()).decode() if b64 else body, b64)


def admit(spark, envs, topic=True):
    df = spark.createDataFrame(envs, landed.ENVELOPE_SCHEMA)
    return [(r.outcome, r.status_code) for r in adm.admit(landed.webhook_envelopes(df), SECRET, topic).collect()]


def test_admission_outcomes(spark):
    closed = json.dumps({**PAYLOAD, "action": "closed"})
    envs = [
        envelope(),  # accepted
        envelope(event="push"),  # ignored event
        envelope(body=closed),  # ignored action
        envelope(signature="bad"),  # bad signature
        envelope(signature="none"),  # no header: check skipped
        envelope(body='{"action": ', signature="none"),  # bad JSON
        envelope(b64=True),  # base64 body, signature over the decoded bytes
        envelope(body="[1, 2]"),  # not an object
    ]
    assert admit(spark, envs) == [
        ("accepted", 200), ("ignored_event", 200), ("ignored_action", 200), ("bad_signature", 401),
        ("accepted", 200), ("invalid_json", 400), ("accepted", 200), ("not_an_object", 500),
    ]
    assert admit(spark, [envelope()], topic=False) == [("topic_not_configured", 500)]


def test_projection_defaults_and_dedupe(spark):
    minimal = json.dumps({"action": "opened"})
    df = spark.createDataFrame([envelope(), envelope(body=minimal)], landed.ENVELOPE_SCHEMA)
    ev = adm.project_webhook_event(adm.admit(landed.webhook_envelopes(df), SECRET)).collect()
    full, empty = ev
    assert (full.repo_full_name, full.pr_number, full.head_sha, full.base_ref, full.installation_id) == ("o/r", 7, "abc", "main", 9)
    assert (empty.repo_full_name, empty.pr_number, empty.installation_id, empty.sender) == ("", 0, 0, "")
    rows = spark.createDataFrame(
        [("o/r", 7, "abc", 2, "x"), ("o/r", 7, "abc", 1, "y"), ("o/r", 8, "abc", 3, "z")],
        "repo_full_name string, pr_number long, head_sha string, received_at long, tag string",
    )
    d = {r.pr_number: (r.tag, r.deliveries) for r in adm.dedupe_deliveries(rows).collect()}
    assert d == {7: ("y", 2), 8: ("z", 1)}


def test_typed_events_quarantine(spark):
    flat = {"action": "opened", "repo_full_name": "o/r", "repo_clone_url": "c", "pr_number": "7", "pr_title": "t",
            "pr_url": "u", "pr_diff_url": "d", "head_sha": "s", "base_ref": "b", "head_ref": "h", "sender": "me"}
    df = spark.createDataFrame([(json.dumps(flat),), (json.dumps(PAYLOAD),), ("nope",)], "text string")
    got = landed.typed_events(df).collect()
    assert got[0].valid and got[0].pr_number == 7 and got[0].installation_id == 0
    assert not got[1].valid and "repo_full_name" in got[1].violations
    assert not got[2].valid


def test_queue_unwrap_and_raw(spark):
    inner = json.dumps({"review_id": "r1"})
    rows = [(json.dumps({"Type": "Notification", "Message": inner}),), (json.dumps({"Message": {"review_id": "r2"}}),),
            (inner,), ("not json",)]
    df = spark.createDataFrame(rows, "body string")
    got = [r[0] for r in df.select(F.get_json_object(landed.unwrap_envelope(F.col("body")), "$.review_id")).collect()]
    assert got == ["r1", "r2", "r1", None]
    raw = landed.queue_messages(df).select("is_raw", F.variant_get("payload", "$.raw", "string")).collect()
    assert raw[3] == (True, "not json") and raw[0][0] is False


def test_message_fates(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("ack", "parse-queue", t, 1, False), ("ack", "parse-queue", t + dt.timedelta(seconds=400), 2, True),
        ("dead", "style-queue", t, 3, False), ("dead", "style-queue", t + dt.timedelta(seconds=1), 4, False),
        ("dead", "style-queue", t + dt.timedelta(seconds=2), 5, False), ("dead", "style-queue", t + dt.timedelta(seconds=3), 6, True),
        ("wait", "test-queue", t, 7, False),
    ]
    df = spark.createDataFrame(rows, "message_id string, queue string, received_at timestamp, receive_seq long, succeeded boolean")
    routes = dash.message_routes(df)
    assert {r.message_id: r.route for r in routes.collect()} == {"ack": "acked", "dead": "dead", "wait": "retry"}
    depth = {r.queue: r.depth for r in dash.queue_depth_all(spark, dash.queue_depth(routes)).collect()}
    assert depth["style-dlq"] == 1 and depth["test-queue"] == 1 and depth["parse-queue"] == 0 and len(depth) == 14


def test_header_names_collide_last_wins(spark):
    body = json.dumps(PAYLOAD)
    env = ({"x-github-event": "push", "X-GitHub-Event": "pull_request"}, body, False)
    df = spark.createDataFrame([env], landed.ENVELOPE_SCHEMA)
    got = landed.webhook_envelopes(df).select(landed.header("x-github-event")).first()[0]
    assert got in ("push", "pull_request")  # map order decides; no failure


def test_skipped_events_are_counted(spark):
    from revlens.sources.store import skip_missing_review_id

    df = spark.createDataFrame([("r1",), ("",), (None,), ("r2",)], "review_id string")
    kept, obs = skip_missing_review_id(df)
    assert sorted(r.review_id for r in kept.collect()) == ["r1", "r2"]
    assert obs.get == {"skipped": 2, "seen": 4}


def test_admission_audit(spark):
    df = spark.createDataFrame([envelope(), envelope(event="push"), envelope(signature="bad"), envelope()], landed.ENVELOPE_SCHEMA)
    audit = {(r.outcome, r.status_code): r.requests for r in adm.admission_audit(adm.admit(landed.webhook_envelopes(df), SECRET)).collect()}
    assert audit == {("accepted", 200): 2, ("ignored_event", 200): 1, ("bad_signature", 401): 1}


def test_redelivery_kinds_and_learn_queue_timeout(spark):
    from revlens.operators.messages import redeliveries

    t = dt.datetime(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    rows = [
        ("a", "parse-queue", t, 1), ("a", "parse-queue", t + 100 * s, 2), ("a", "parse-queue", t + 500 * s, 3),
        ("b", "learn-queue", t, 4), ("b", "learn-queue", t + 150 * s, 5),
    ]
    df = spark.createDataFrame(rows, "message_id string, queue string, received_at timestamp, receive_seq long")
    got = {r.receive_seq: r.kind for r in redeliveries(df).collect()}
    # parse queue: 100 s < 300 s early, 400 s after the timeout; learn queue: 150 s >= 120 s
    assert got == {1: "early", 2: "after_timeout", 3: "last", 4: "after_timeout", 5: "last"}


def test_kafka_messages_shape(spark):
    schema = ("key binary, value binary, topic string, partition int, offset long, timestamp timestamp, "
              "timestampType int, headers array<struct<key:string,value:binary>>")
    t = dt.datetime(2024, 1, 1)
    rows = [(None, b'{"a": 1}', "pr-parsed", 3, 17, t, 0, [("event_type", b"pr.parsed")]),
            (None, b"{}", "pr-parsed", 0, 1, t, 0, None)]
    got = landed.kafka_messages(spark.createDataFrame(rows, schema)).orderBy("message_id").collect()
    assert [(r.message_id, r.body, r.attributes) for r in got] == [
        ("pr-parsed-0-1", "{}", {}), ("pr-parsed-3-17", '{"a": 1}', {"event_type": "pr.parsed"})]


def test_no_poison_rows(spark):
    """Bodies that cannot be decoded, parsed or typed end in an outcome, each its own."""
    import base64
    import json

    from revlens.operators import admission as adm
    from revlens.sources import landed

    good = {"action": "opened", "pull_request": {"number": 7, "head": {"sha": "s"}}, "repository": {"full_name": "o/r"}}
    text = json.dumps(good)
    bodies = {
        "good": (text, False), "base64": (base64.b64encode(text.encode()).decode(), True),
        "bad base64": ("%%%", True), "bad utf8": (base64.b64encode(b"\xff\xfe" + text.encode()).decode(), True),
        "prose after": (text + " xyz", False), "two values": (text + text, False), "two closed": (text + "],[" + text, False),
        "number abc": (json.dumps({**good, "pull_request": {"number": "abc"}}), False),
        "number object": (json.dumps({**good, "pull_request": {"number": {"a": 1}}}), False),
        "number huge": (json.dumps({**good, "pull_request": {"number": 10**30}}), False),
        "number digits": (json.dumps({**good, "pull_request": {"number": " 12 "}}), False),
        "pr null": (json.dumps({**good, "pull_request": None}), False), "title list": (json.dumps({**good, "pull_request": {"title": [1]}}), False),
        "ignored abc": (json.dumps({"action": "closed", "pull_request": {"number": "abc"}}), False),
    }
    rows = [(k, {"X-GitHub-Event": "pull_request"}, b, f) for k, (b, f) in bodies.items()]
    env = landed.webhook_envelopes(spark.createDataFrame(rows, "name string, headers map<string,string>, body string, isBase64Encoded boolean"))
    out = adm.project_webhook_event(adm.admit(env, ""))
    got = {r["name"]: (r.outcome, r.status_code, r.pr_number) for r in out.collect()}
    assert got["good"] == got["base64"] == ("accepted", 200, 7)
    assert got["number digits"] == ("accepted", 200, 12)
    assert {got[k][:2] for k in ("bad base64", "bad utf8")} == {("bad_body", 500)}
    assert {got[k][:2] for k in ("prose after", "two values", "two closed")} == {("invalid_json", 400)}
    bad = ("number abc", "number object", "number huge", "pr null", "title list")
    assert {got[k][:2] for k in bad} == {("invalid_event", 500)}
    assert got["ignored abc"][0] == "ignored_action"
    m = landed.queue_messages(spark.createDataFrame([('{"a": 1} xyz',), ('{"a": 1}',)], "body string")).collect()
    assert [r.is_raw for r in m] == [True, False]


def test_line_out_of_range(spark):
    from revlens.operators.respond import decode_replies

    text = '{"findings": [{"line": 3}, {"line": "99999999999999999999999"}, {"line": 1e40}]}'
    df = spark.createDataFrame([("style", text, 1, 1), ("style", text + " {}", 1, 1)], "agent string, text string, tokens_in int, tokens_out int")
    got = decode_replies(df).collect()
    assert got[0].outcome == "invalid" and [f.line for f in got[0].findings] == [3]
    assert got[1].outcome == "bad_json"


def test_nested_event_models(spark):
    import json

    from revlens.sources import landed

    base = {"review_id": "r", "repo_full_name": "o/r", "pr_number": 3, "pr_url": "u", "head_sha": "s"}
    good = {"severity": "info", "category": "c", "file": "f", "message": "m"}
    rows = {
        "ok": {**base, "findings": [good], "agent_meta": {"agent": "style", "tokens_in": 7, "tools_called": ["a"]}},
        "no findings": base, "bad severity": {**base, "findings": [good, {**good, "severity": "URGENT"}]},
        "not a list": {**base, "findings": {"a": 1}}, "tools": {**base, "agent_meta": {"agent": "x", "tools_called": [1]}},
        "no review": {k: v for k, v in base.items() if k != "review_id"}, "null list": {**base, "findings": None},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()] + [("prose", json.dumps(base) + " x")], "name string, text string")
    typed = landed.typed_events(df, fields=landed.EVENT_MODELS["review"])
    got = {r["name"]: (r.valid, list(r.violations)) for r in typed.collect()}
    assert got["ok"] == got["no findings"] == (True, [])
    assert got["bad severity"][1] == got["not a list"][1] == got["null list"][1] == ["findings"]
    assert got["tools"][1] == ["agent_meta"] and got["no review"][1] == ["review_id"] and not got["prose"][0]
    row = typed.where("name = 'ok'").first()
    assert (row.files_analyzed, row.event_type, json.loads(row.findings)[0]["file"]) == (0, "review.security", "f")
    assert landed.quarantined(typed).count() == 6 - 1 + 1 - 0 and set(landed.quarantined(typed).columns) == {"text", "violations"}

    chunk = {"chunk_index": 0, "total_chunks": 1, "files": [{"path": "p", "language": "go", "status": "added"}]}
    parsed = {**base, "pr_title": "t", "base_ref": "b", "head_ref": "h", "sender": "me", "chunks": [chunk]}
    bad = {**parsed, "chunks": [{**chunk, "files": [{"path": "p", "language": "go", "status": "copied"}]}]}
    df = spark.createDataFrame([("ok", json.dumps(parsed)), ("bad", json.dumps(bad))], "name string, text string")
    got = {r["name"]: list(r.violations) for r in landed.typed_events(df, fields=landed.EVENT_MODELS["parsed"]).collect()}
    assert got == {"ok": [], "bad": ["chunks"]}
