"""Operator inputs derived from the benchmark tables.

The benchmark ships generic tables (documents, events, conversations, orders).
Each review-domain input below is a deterministic, row-level rewrite of one of
them, so its size grows with the scale factor. Row-level definitions are plain
SQL accepted verbatim by Spark and by DuckDB (the correctness oracle reads the
same text), which guarantees both engines start from identical rows.
Aggregations, windows and nesting are never done here: those are the operators
under test and live in `revlens.operators`.

Planted credentials are assembled from pieces inside the SQL so that this
repository carries no literal a secret scanner would flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens import rules
from revlens.functions.crypto import padded_keys

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The webhook secret used for the derived request envelopes.
WEBHOOK_SECRET = "revlens-test-webhook-secret"
# Fixed "now" for time-window operators over the events table.
EVENTS_NOW = "2024-01-30 12:00:00"

_NL = "chr(10)"
_Q = "chr(34)"  # double quote
_SQ = "chr(39)"  # single quote


def _s(expr: str) -> str:
    return f"cast({expr} as string)"


# 10 planted added lines, chosen by doc_id % 10: the 8 rules in order, one line
# hitting two rules (the earlier rule must win) and one clean line.
_PLANTED = [
    f"'aws_key = ' || {_Q} || 'AK' || 'IA' || lpad({_s('doc_id')}, 16, '7') || {_Q}",
    f"'aws_secret_access_key = ' || {_SQ} || md5({_s('doc_id')}) || 'AbCd/+=x' || {_SQ}",
    f"'API_KEY: ' || {_Q} || md5({_s('doc_id')}) || {_Q}",
    f"'db_password = ' || {_Q} || 'pw-' || {_s('doc_id')} || '-long' || {_Q}",
    "'-----BEGIN ' || 'EC PRIVATE' || ' KEY-----'",
    "'token: ' || 'gh' || 'p_' || md5(" + _s("doc_id") + ") || 'abcd'",
    f"'auth = ' || 'ey' || 'J' || 'hbGciOiJIUzI1NiJ9' || '.ey' || 'J' || 'zdWIiOi' || {_s('doc_id')} || 'fQ' || '.sig_' || {_s('doc_id')}",
    f"'url = ' || {_Q} || 'post' || 'gres://' || 'svc:pw@db' || {_s('doc_id')} || '.internal/app' || {_Q}",
    f"'key = ' || {_Q} || 'AK' || 'IA' || lpad({_s('doc_id')}, 16, '3') || {_Q} || ' password = ' || {_Q} || 'pw-' || {_s('doc_id')} || '-long' || {_Q}",
    f"'total = compute(' || {_s('doc_id')} || ')'",
]

# A patch: every line of the text as an added line, a planted line, and removed lines.
_N_LINES = f"(length(text) - length(replace(text, {_NL}, '')) + 2)"
_PATCH = (
    f"'@@ -1,' || {_s('doc_id % 300 + 1')} || ' +1,' || {_s(_N_LINES)} || ' @@' || {_NL}"
    f" || '+' || replace(text, {_NL}, {_NL} || '+')"
    f" || {_NL} || '-old_password = ' || {_Q} || 'was-' || {_s('doc_id')} || '-secret' || {_Q}"
    f" || repeat({_NL} || '-old line', cast(doc_id % 300 as int))"
    f" || {_NL} || '+' || CASE doc_id % 10 "
    + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PLANTED[:-1]))
    + f" ELSE {_PLANTED[-1]} END"
)

# One changed file per document, with as many additions and deletions as its patch has,
# and for each 23rd document a further file without a patch (a picture). A review holds
# the files of one source and 4,000 consecutive documents: 200 and a few pictures.
_REVIEW_OF_DOC = f"'rev-' || source || '-' || {_s('cast(floor(doc_id / 4000) as bigint)')}"
PR_FILES_SQL = f"""
SELECT
  {_REVIEW_OF_DOC} AS review_id,
  doc_id * 2 AS ordinal,
  CASE doc_id % 12
    WHEN 0 THEN 'src/' || source || '/mod_' || {_s('doc_id')} || '.py'
    WHEN 1 THEN 'web/App' || {_s('doc_id')} || '.TSX'
    WHEN 2 THEN 'deploy/Dockerfile'
    WHEN 3 THEN 'Dockerfile.' || lang
    WHEN 4 THEN 'tools/Makefile'
    WHEN 5 THEN 'home/' || source || '/.bashrc'
    WHEN 6 THEN 'web/' || {_s('doc_id')} || '/package-lock.json'
    WHEN 7 THEN 'dist/bundle_' || {_s('doc_id')} || '.js'
    WHEN 8 THEN 'pkg/util_' || {_s('doc_id')} || '.go'
    WHEN 9 THEN 'v2.data/blob_' || {_s('doc_id')} || '.xyz'
    WHEN 10 THEN 'ops/api_' || {_s('doc_id')} || '.dockerfile'
    ELSE 'db/query_' || {_s('doc_id')} || '.SQL'
  END AS filename,
  CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed'
    WHEN 3 THEN 'renamed' ELSE 'copied' END AS status,
  {_N_LINES} AS additions,
  doc_id % 300 + 1 AS deletions,
  {_PATCH} AS patch,
  CASE WHEN doc_id % 5 = 3 THEN 'old/' || {_s('doc_id')} || '.txt' END AS previous_filename
FROM documents
UNION ALL
SELECT {_REVIEW_OF_DOC}, doc_id * 2 + 1, 'img/shot_' || {_s('doc_id')} || '.png', 'added', 0, 0, '', NULL
FROM documents
WHERE doc_id % 23 = 22
"""

_AGENT_BY_TYPE = (
    "CASE event_type WHEN 'view' THEN 'security' WHEN 'click' THEN 'performance' "
    "WHEN 'purchase' THEN 'style' ELSE 'test' END"
)
_SEV_RAW = (
    "CASE event_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' "
    "WHEN 3 THEN 'CRITICAL' WHEN 4 THEN 'Warning' WHEN 5 THEN 'INFO' ELSE 'urgent' END"
)
_CATEGORIES = ["sql_injection", "n-plus-one", "hardcoded_secret", "naming", "missing_test", "other", "memory(leak)"]

# Stored findings (one event = one finding of one reviewer). Users with
# user_id % 10 = 9 have none (clean reviews); reviewer `test` is silent for
# user_id % 4 = 3 (incomplete reviews); critical turns into warning for
# user_id % 3 = 1 so that all three verdicts occur.
FINDINGS_SQL = f"""
SELECT
  'rev-' || {_s('user_id')} AS review_id,
  event_id AS ordinal,
  {_AGENT_BY_TYPE} AS agent,
  CASE WHEN user_id % 3 = 1 AND lower({_SEV_RAW}) = 'critical'
       THEN CASE WHEN {_SEV_RAW} = 'CRITICAL' THEN 'WARNING' ELSE 'warning' END
       ELSE {_SEV_RAW} END AS severity,
  CASE event_id % 7 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES[:-1]))} ELSE '{_CATEGORIES[-1]}' END AS category,
  'src/f' || {_s('event_id % 13')} || '.py' AS file,
  cast(floor(event_id / 13) as bigint) % 4 AS line,
  'Issue ' || {_s('event_id')} || ' (' || event_type || ')' AS message,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Fix ' || {_s('event_id')} END AS suggestion,
  'org/repo-' || {_s('user_id % 7')} AS repo,
  user_id AS pr_number,
  ts
FROM events
WHERE event_type <> 'error' AND user_id % 10 <> 9
  AND NOT ({_AGENT_BY_TYPE} = 'test' AND user_id % 4 = 3)
"""

# Review meta rows, one per events row of type 'signup' is too sparse; we use
# every event and let the review operator aggregate. This view is row-level:
# the per-user grouping is the `reviews_in` operator input builder below.
REVIEW_EVENTS_SQL = f"""
SELECT
  'rev-' || {_s('user_id')} AS review_id,
  CASE WHEN user_id % 11 = 10 THEN NULL ELSE 'org/repo-' || {_s('user_id % 7')} END AS repo,
  user_id AS pr_number,
  'https://example.com/org/repo-' || {_s('user_id % 7')} || '/pull/' || {_s('user_id')} AS pr_url,
  CASE WHEN user_id % 13 = 12 THEN NULL WHEN user_id % 2 = 0 THEN 'complete'
       ELSE 'parsing_complete' END AS status,
  event_type,
  event_id AS write_seq,
  ts
FROM events
"""

def _json_str(expr: str) -> str:
    """JSON string literal of `expr` (escape backslash, quote, CR, LF, TAB)."""
    e = f"replace({expr}, chr(92), chr(92) || chr(92))"
    e = f"replace({e}, chr(34), chr(92) || chr(34))"
    e = f"replace({e}, chr(10), chr(92) || 'n')"
    e = f"replace({e}, chr(13), chr(92) || 'r')"
    e = f"replace({e}, chr(9), chr(92) || 't')"
    return f"chr(34) || {e} || chr(34)"


_RESP_A = (
    f"'{{' || {_Q} || 'severity' || {_Q} || ': ' || {_Q} || "
    "CASE turn % 4 WHEN 1 THEN 'HIGH' WHEN 3 THEN 'Warning' ELSE 'critical' END || "
    f"{_Q} || ', ' || {_Q} || 'category' || {_Q} || ': ' || {_Q} || "
    "CASE conv_id % 3 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'memory' ELSE 'naming' END || "
    f"{_Q} || ', ' || {_Q} || 'file' || {_Q} || ': ' || {_Q} || 'src/c' || {_s('conv_id % 5')} || '.py' || {_Q} || "
    f"', ' || {_Q} || 'line' || {_Q} || ': ' || {_s('turn')} || "
    f"', ' || {_Q} || 'message' || {_Q} || ': ' || {_json_str('text')} || "
    f"', ' || {_Q} || 'suggestion' || {_Q} || ': ' || {_Q} || 'see turn ' || {_s('turn')} || {_Q} || '}}'"
)
_RESP_B = f"'{{' || {_Q} || 'severity' || {_Q} || ': ' || {_Q} || 'info' || {_Q} || ', ' || {_Q} || 'line' || {_Q} || ': ' || {_Q} || '7' || {_Q} || '}}'"
_RESP_BAD = f"'{{' || {_Q} || 'severity' || {_Q} || ': null, ' || {_Q} || 'line' || {_Q} || ': ' || {_Q} || 'abc' || {_Q} || '}}'"
_FIND = f"'{{' || {_Q} || 'findings' || {_Q} || ': ['"

# Model replies: one per turn, its whole text inside a finding's message or as prose
# around it; six shapes by (conv_id + turn) % 6:
# bare JSON, ```json fence with prose, plain ``` fence with an empty list,
# not JSON at all, an object without `findings`, and a list with a malformed
# element between two good ones.
RESPONSES_SQL = f"""
SELECT
  'rev-c' || {_s('conv_id')} AS review_id,
  CASE conv_id % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'style' ELSE 'test' END AS agent,
  cast(turn as bigint) AS chunk_index,
  CASE (conv_id + turn) % 6
    WHEN 0 THEN {_FIND} || {_RESP_A} || ', ' || {_RESP_B} || ']}}'
    WHEN 1 THEN 'Here is my review:' || {_NL} || '```json' || {_NL} || {_FIND} || {_RESP_A} || ']}}' || {_NL} || '```' || {_NL} || 'Done: ' || text
    WHEN 2 THEN '```' || {_NL} || {_FIND} || ']}}' || {_NL} || '```'
    WHEN 3 THEN 'I found nothing worth reporting: ' || text
    WHEN 4 THEN '{{}}'
    ELSE {_FIND} || {_RESP_A} || ', ' || {_RESP_BAD} || ', ' || {_RESP_B} || ']}}'
  END AS text,
  100 + length(text) AS tokens_in,
  20 + conv_id % 50 AS tokens_out,
  200 + 10 * turn AS latency_ms,
  'offline' AS model_id
FROM conversations
"""

# Webhook requests, one per order; two consecutive orders are two deliveries
# for the same pull request (pr_no = o_orderkey / 2). Event header, action,
# signature state, base64 flag, malformed bodies, numbers that are none, text after
# the JSON, bad base64 and bytes that are not UTF-8 cycle with different moduli.
_ACTIONS = ["opened", "synchronize", "reopened", "closed", "labeled"]
_BODY = (
    f"CASE WHEN o_orderkey % 11 = 10 THEN '{{' || {_Q} || 'action' || {_Q} || ': ' || {_Q} || 'opened' || {_Q} || ', '"
    f" ELSE '{{' || {_Q} || 'action' || {_Q} || ': ' || {_Q} || "
    f"CASE o_orderkey % 5 {' '.join(f'WHEN {i} THEN {chr(39)}{a}{chr(39)}' for i, a in enumerate(_ACTIONS))} END || {_Q}"
    f" || ', ' || {_Q} || 'number' || {_Q} || ': ' || {_s('pr_no')}"
    f" || ', ' || {_Q} || 'pull_request' || {_Q} || ': {{' || {_Q} || 'number' || {_Q} || ': ' || "
    f"CASE WHEN o_orderkey % 19 = 18 THEN {_Q} || 'abc' || {_Q} ELSE {_s('pr_no')} END"
    f" || ', ' || {_Q} || 'title' || {_Q} || ': ' || {_Q} || 'Order ' || o_orderpriority || {_Q}"
    f" || ', ' || {_Q} || 'html_url' || {_Q} || ': ' || {_Q} || 'https://example.com/pull/' || {_s('pr_no')} || {_Q}"
    f" || ', ' || {_Q} || 'diff_url' || {_Q} || ': ' || {_Q} || 'https://example.com/pull/' || {_s('pr_no')} || '.diff' || {_Q}"
    f" || ', ' || {_Q} || 'head' || {_Q} || ': {{' || {_Q} || 'sha' || {_Q} || ': ' || {_Q} || md5({_s('pr_no')}) || {_Q}"
    f" || ', ' || {_Q} || 'ref' || {_Q} || ': ' || {_Q} || 'feature/' || o_orderstatus || {_Q} || '}}'"
    f" || CASE WHEN o_orderkey % 13 = 12 THEN '' ELSE ', ' || {_Q} || 'base' || {_Q} || ': {{' || {_Q} || 'ref' || {_Q} || ': ' || {_Q} || 'main' || {_Q} || '}}' END"
    f" || '}}, ' || {_Q} || 'repository' || {_Q} || ': {{' || {_Q} || 'full_name' || {_Q} || ': ' || {_Q} || 'org/shop-' || {_s('o_custkey % 9')} || {_Q}"
    f" || ', ' || {_Q} || 'clone_url' || {_Q} || ': ' || {_Q} || 'https://example.com/org/shop-' || {_s('o_custkey % 9')} || '.git' || {_Q} || '}}'"
    f" || ', ' || {_Q} || 'sender' || {_Q} || ': {{' || {_Q} || 'login' || {_Q} || ': ' || {_Q} || 'user' || {_s('o_custkey')} || {_Q} || '}}'"
    f" || CASE WHEN o_orderkey % 17 = 16 THEN '' ELSE ', ' || {_Q} || 'installation' || {_Q} || ': {{' || {_Q} || 'id' || {_Q} || ': ' || {_s('o_custkey * 1000')} || '}}' END"
    f" || '}}' END"
)


def _sha256(expr: str, dialect: str) -> str:
    return f"sha2({expr}, 256)" if dialect == "spark" else f"sha256({expr})"


def _utf8(expr: str, dialect: str) -> str:
    return f"encode({expr}, 'UTF-8')" if dialect == "spark" else f"encode({expr})"


def _b64(data: str, dialect: str) -> str:
    # Spark's base64 wraps lines at 76 characters (MIME); request bodies are one line.
    if dialect == "spark":
        return f"replace(base64({data}), chr(13) || chr(10), '')"
    return f"base64({data})"


def _requests_sql(dialect: str) -> str:
    ipad, opad = padded_keys(WEBHOOK_SECRET)
    inner = _sha256(f"unhex('{ipad.hex()}') || {_utf8('body_raw', dialect)}", dialect)
    raw = _utf8("body_raw", dialect)
    good = "'sha256=' || " + _sha256(f"unhex('{opad.hex()}') || unhex({inner})", dialect)
    return f"""
SELECT
  request_id,
  CASE WHEN request_id % 7 = 6 THEN 'push' ELSE 'pull_request' END AS header_event,
  CASE request_id % 4 WHEN 1 THEN 'sha256=' || md5(body_raw) || md5(body_raw)
                      WHEN 2 THEN NULL ELSE {good} END AS header_signature,
  request_id % 3 = 2 AS is_base64,
  CASE WHEN request_id % 3 <> 2 THEN body_raw
       WHEN request_id % 29 = 28 THEN {_b64(raw, dialect)} || '*'
       WHEN request_id % 31 = 30 THEN {_b64("unhex('FFFE') || " + raw, dialect)}
       ELSE {_b64(raw, dialect)} END AS body,
  o_orderdate AS received_at
FROM (SELECT o_orderkey AS request_id, o_orderdate,
        ({_BODY}) || CASE WHEN o_orderkey % 23 = 22 THEN ' xyz' ELSE '' END AS body_raw
      FROM (SELECT *, cast(floor(o_orderkey / 2) AS bigint) AS pr_no FROM orders) o) r
"""


_FUNCTION_BY_TYPE = (
    "CASE event_type WHEN 'view' THEN 'webhook' WHEN 'click' THEN 'parser' WHEN 'purchase' THEN 'security' "
    "WHEN 'signup' THEN 'style' ELSE 'performance' END"
)
# Function invocations: one per event; errors are values above 100.
INVOCATIONS_SQL = f"""
SELECT {_FUNCTION_BY_TYPE} AS function, ts, value > 100 AS is_error, value AS duration_ms
FROM events
"""

# Queue receive log: every event is one receive. Three events with consecutive ids are
# the receives of one message (each ninth event is a message of its own), from one of the
# 7 main queues; processing succeeds when value < 60.
RECEIVES_SQL = f"""
SELECT CASE WHEN event_id % 9 = 8 THEN 's' || {_s('event_id')} ELSE 'm' || {_s('cast(floor(event_id / 3) as bigint)')} END AS message_id,
  CASE cast(floor(event_id / 3) as bigint) % 7 {" ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate([q for q in rules.QUEUES if not q.endswith('-dlq')]))} END AS queue,
  ts AS received_at,
  event_id AS receive_seq,
  value < 60 AS succeeded
FROM events
"""


# Changed files as landed by the hosting API: one JSON object per file, with
# `patch` null for some (binary) files and `previous_filename` only on renames.
PR_FILE_JSON_SQL = f"""
SELECT review_id, ordinal,
  '{{"filename": ' || {_json_str('filename')} || ', "status": ' || {_json_str('status')}
  || ', "additions": ' || {_s('additions')} || ', "deletions": ' || {_s('deletions')}
  || ', "patch": ' || CASE WHEN patch = '' THEN 'null' ELSE {_json_str('patch')} END
  || CASE WHEN previous_filename IS NULL THEN '' ELSE ', "previous_filename": ' || {_json_str('previous_filename')} END
  || '}}' AS file_json
FROM ({PR_FILES_SQL}) f
"""

# The same objects by pull request, for the connected pipeline: 40 consecutive documents
# are the files of the pull request that the webhook requests name by this number and head.
LANDED_PR_FILES_SQL = f"""
SELECT cast(floor(ordinal / 80) as bigint) AS pr_number, md5({_s('cast(floor(ordinal / 80) as bigint)')}) AS head_sha,
  ordinal, file_json
FROM ({PR_FILE_JSON_SQL}) j
"""

# Pull-request metadata as landed by the hosting API, one object per order.
PR_META_JSON_SQL = f"""
SELECT o_orderkey AS pr_number,
  '{{"title": "Order ' || {_s('o_orderkey')} || '", "body": '
  || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE {_json_str('o_orderpriority')} END
  || ', "html_url": "https://example.com/pull/' || {_s('o_orderkey')} || '"'
  || ', "diff_url": "https://example.com/pull/' || {_s('o_orderkey')} || '.diff"'
  || ', "head": {{"sha": "' || md5({_s('o_orderkey')}) || '", "ref": "feature/' || o_orderstatus || '"}}'
  || ', "base": {{"ref": "main"}}, "user": {{"login": "user' || {_s('o_custkey')} || '"}}'
  || ', "labels": [' || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{{"name": "p' || {_s('o_orderkey % 5')} || '"}}'
       ELSE '{{"name": "' || o_orderstatus || '"}}, {{"name": "triage"}}' END || ']'
  || ', "created_at": "' || {_s('o_orderdate')} || '"'
  || ', "updated_at": ' || CASE WHEN o_orderkey % 6 = 5 THEN 'null' ELSE '"' || {_s('o_orderdate')} || '"' END
  || '}}' AS meta_json
FROM orders
"""

# review.complete messages (one per events row); review_id is empty for
# error events, which the consumers must skip.
COMPLETE_EVENTS_SQL = f"""
SELECT event_id AS message_id, ts,
  '{{"review_id": "' || CASE WHEN event_type = 'error' THEN '' ELSE 'rev-' || {_s('user_id')} END
  || '", "verdict": "' || CASE user_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'comment' ELSE 'request_changes' END
  || '", "latency_ms": ' || {_s('event_id % 997')} || '}}' AS body
FROM events
"""


def _review_clock_sql(dialect: str) -> str:
    """Finding events on a per-review clock: review u opens at 60*u seconds
    after 2024-01-01 and its events arrive within 30 s (event_id % 30). Every
    events row is kept; rows that are not findings carry no reviewer (NULL
    agent) and only move event time forward, as does a tick a minute after each
    event."""
    secs = "1704067200 + user_id * 60 + event_id % 30"
    def at(secs: str) -> str:
        return f"timestamp_seconds({secs})" if dialect == "spark" else f"make_timestamp(({secs}) * 1000000)"

    is_finding = f"(event_type <> 'error' AND user_id % 10 <> 9 AND NOT ({_AGENT_BY_TYPE} = 'test' AND user_id % 4 = 3))"
    return f"""
SELECT 'rev-' || {_s('user_id')} AS review_id,
  CASE WHEN {is_finding} THEN {_AGENT_BY_TYPE} END AS agent,
  event_id,
  {at(secs)} AS ts
FROM events
UNION ALL
SELECT 'rev-' || {_s('user_id')}, NULL, event_id, {at(secs + ' + 60')}
FROM events
"""


_STATIC_SQL: dict[str, str] = {
    "pr_files": PR_FILES_SQL,
    "findings_in": FINDINGS_SQL,
    "review_events": REVIEW_EVENTS_SQL,
    "responses": RESPONSES_SQL,
    "invocations": INVOCATIONS_SQL,
    "receives": RECEIVES_SQL,
    "pr_file_json": PR_FILE_JSON_SQL,
    "landed_pr_files": LANDED_PR_FILES_SQL,
    "pr_meta_json": PR_META_JSON_SQL,
    "complete_events": COMPLETE_EVENTS_SQL,
}
DERIVED_NAMES = tuple(_STATIC_SQL) + ("requests", "review_clock")


def derived_sql(name: str, dialect: str = "spark") -> str:
    """SQL text of a derived input for `dialect` ("spark" or "duckdb")."""
    if name == "requests":
        return _requests_sql(dialect)
    if name == "review_clock":
        return _review_clock_sql(dialect)
    return _STATIC_SQL[name]


def register_base(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None) -> None:
    """Register the benchmark tables of `sf_dir` as temp views."""
    for name in tables or BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


_SOURCE_TABLE = {
    "pr_files": "documents",
    "findings_in": "events",
    "review_events": "events",
    "responses": "conversations",
    "invocations": "events",
    "receives": "events",
    "requests": "orders",
    "pr_file_json": "documents",
    "landed_pr_files": "documents",
    "pr_meta_json": "orders",
    "complete_events": "events",
    "review_clock": "events",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input as a lazy DataFrame over the benchmark table."""
    register_base(spark, sf_dir, (_SOURCE_TABLE[name],))
    return spark.sql(derived_sql(name, "spark"))


_TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def derived_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A derived input over a *stream* of its benchmark table (file source on
    the table's landing folder). Row-level views apply to streams unchanged."""
    table = _SOURCE_TABLE[name]
    stream = (
        spark.readStream.schema(_TABLE_SCHEMAS[table])
        .option("pathGlobFilter", f"{table}.parquet")
        .option("maxFilesPerTrigger", max_files)
        .parquet(sf_dir)
    )
    view = f"{table}_stream"
    stream.createOrReplaceTempView(view)
    text = derived_sql(name, "spark")
    return spark.sql(text.replace(f"FROM {table}\n", f"FROM {view}\n").replace(f"FROM {table})", f"FROM {view})"))
