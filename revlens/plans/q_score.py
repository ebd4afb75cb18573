"""Inference family and the end-to-end batch pipeline (offline scorer)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from revlens import rules
from revlens.operators import dashboard as dash
from revlens.operators.score import route_models, route_table
from revlens.plans import oracle as o
from revlens.plans.batch import review_batch
from revlens.plans.offline import no_sleep, offline_scorer_factory
from revlens.plans.q_findings import comment_tail_sql
from revlens.plans.q_parse import _CHUNK_SQL
from revlens.plans.registry import register
from revlens.session import configure
from revlens.sources.driver import derived


def batch(spark: SparkSession, sf_dir: str):
    configure(spark)
    return review_batch(derived(spark, sf_dir, "pr_files"), offline_scorer_factory, sleep=no_sleep)


_MODEL_CASE = (
    "CASE agent "
    + " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in rules.MODEL_ROUTES.items())
    + f" ELSE {o.q(rules.DEFAULT_MODEL)} END"
)
_REVIEWER_MODEL_CASE = (
    "CASE agent " + " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in rules.REVIEWER_MODELS.items()) + " END"
)
_REVIEWERS_SQL = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"({o.q(a)}, {o.q(c)}, {o.q(e)}, {o.q(rules.ON_INVALID[a])})" for a, c, e in rules.REVIEWERS)
    + ") t(agent, default_category, event_type, on_invalid)"
)
_NL = "chr(10)"

_PIPE = (
    _CHUNK_SQL.rstrip()
    + f""",
prompts AS (
  SELECT a.review_id, a.chunk_index, max(a.total_chunks) AS total_chunks, count(*) AS n_files,
    'Review this code diff (chunk ' || cast(a.chunk_index + 1 AS varchar) || '/' || cast(max(a.total_chunks) AS varchar)
      || '):' || {_NL} || {_NL} ||
    string_agg('### File: ' || c.path || ' (language: ' || c.language || ')' || {_NL} || '```diff' || {_NL} || c.patch
      || {_NL} || '```' || {_NL}, {_NL} ORDER BY a.ordinal) AS prompt
  FROM assigned a JOIN changes c USING (review_id, ordinal) GROUP BY a.review_id, a.chunk_index),
reviewers AS ({_REVIEWERS_SQL}),
fanned AS (SELECT p.*, r.* FROM prompts p CROSS JOIN reviewers r),
scored AS (
  SELECT review_id, chunk_index, total_chunks, n_files, agent, default_category, event_type, {_REVIEWER_MODEL_CASE} AS model_id,
    CASE WHEN chunk_index % 11 = 10 THEN 1 WHEN chunk_index % 13 = 12 THEN 3 WHEN chunk_index % 5 = 3 THEN 2 ELSE 1 END AS attempts,
    CASE WHEN chunk_index % 11 = 10 THEN 0.0 WHEN chunk_index % 13 = 12 THEN 7.0 WHEN chunk_index % 5 = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS waited_s,
    CASE WHEN chunk_index % 11 = 10 THEN 'ValidationException' WHEN chunk_index % 13 = 12 THEN 'ThrottlingException' END AS error,
    length(prompt) AS prompt_chars
  FROM fanned),
mfind AS (
  SELECT s.review_id, s.chunk_index, s.agent, c.ordinal AS file_ordinal, c.path, c.language, c.patch,
         len(string_split(c.patch, {_NL})) AS n_lines
  FROM scored s JOIN assigned a ON a.review_id = s.review_id AND a.chunk_index = s.chunk_index
  JOIN changes c ON c.review_id = a.review_id AND c.ordinal = a.ordinal
  WHERE s.error IS NULL AND NOT (s.agent = 'performance' AND s.chunk_index % 9 = 8)),
model AS (
  SELECT review_id, chunk_index, agent, file_ordinal,
    CASE agent WHEN 'security' THEN 'warning' WHEN 'performance' THEN CASE WHEN n_lines < 30 THEN 'info' ELSE 'warning' END
               WHEN 'style' THEN 'info' ELSE 'warning' END AS severity,
    CASE agent WHEN 'security' THEN 'hardcoded_secret' WHEN 'performance' THEN 'algorithm' WHEN 'style' THEN 'naming'
               ELSE 'missing_test' END AS category,
    path AS file,
    cast(CASE agent WHEN 'security' THEN n_lines WHEN 'performance' THEN 1 WHEN 'style' THEN 2 ELSE 0 END AS BIGINT) AS line,
    CASE agent WHEN 'security' THEN 'Credential-like value on the last added line'
               WHEN 'performance' THEN 'Review loop cost over ' || cast(n_lines AS varchar) || ' lines'
               WHEN 'style' THEN 'Inconsistent naming' ELSE 'Container build is untested' END AS message,
    CASE agent WHEN 'security' THEN 'Load it at runtime' WHEN 'performance' THEN 'Batch the work'
               WHEN 'style' THEN 'Follow the project convention' ELSE 'Add a build check' END AS suggestion
  FROM mfind
  WHERE (agent = 'security' AND patch <> '') OR (agent = 'performance' AND language IN ('python', 'go', 'sql', 'tsx'))
     OR (agent = 'style' AND n_lines % 2 = 0) OR (agent = 'test' AND language = 'dockerfile')),
model_pos AS (
  SELECT *, row_number() OVER (PARTITION BY review_id, chunk_index, agent ORDER BY file_ordinal) - 1 AS pos FROM model),
secrets AS ({o.secret_findings_sql()}),
sec_all AS (
  SELECT review_id, 'security' AS agent, cast(-1 AS BIGINT) AS chunk_index, ordinal,
         severity, category, file, line, message, suggestion, 0 AS source_rank FROM secrets
  UNION ALL
  SELECT review_id, agent, chunk_index, pos, severity, category, file, line, message, suggestion, 1
  FROM model_pos WHERE agent = 'security'),
sec AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY review_id, file, line, category
                                 ORDER BY source_rank, chunk_index, ordinal) AS rn FROM sec_all) WHERE rn = 1),
every AS (
  SELECT * FROM sec
  UNION ALL
  SELECT review_id, agent, chunk_index, pos, severity, category, file, line, message, suggestion, 1
  FROM model_pos WHERE agent <> 'security'),
keyed AS (
  SELECT *, 'FINDING#' || agent || '#' || cast(row_number() OVER (PARTITION BY review_id, agent
         ORDER BY source_rank, chunk_index, ordinal, line) - 1 AS varchar) AS sk FROM every),
winners AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY review_id, file, line
                                 ORDER BY CASE WHEN severity = 'critical' THEN 0 ELSE 1 END, sk) AS rn
    FROM keyed) WHERE rn = 1),
ranked AS (
  SELECT *, {o.sev_norm_sql("severity")} AS bucket FROM winners),
counts AS (
  SELECT review_id, count(*) FILTER (WHERE bucket = 'critical') AS n_critical,
         count(*) FILTER (WHERE bucket = 'warning') AS n_warning,
         count(*) FILTER (WHERE bucket = 'info') AS n_info, count(*) AS total_findings,
         count(DISTINCT CASE WHEN file <> '' THEN file END) AS distinct_files
  FROM ranked GROUP BY review_id),
verdicts AS (
  SELECT r.review_id, coalesce(n_critical, 0) AS n_critical, coalesce(n_warning, 0) AS n_warning,
         coalesce(n_info, 0) AS n_info, coalesce(total_findings, 0) AS total_findings, 0 AS latency_ms,
         greatest(1, coalesce(distinct_files, 0)) AS distinct_files,
         CASE WHEN coalesce(n_critical, 0) > 0 THEN 'request_changes'
              WHEN coalesce(n_warning, 0) + coalesce(n_info, 0) > 0 THEN 'comment' ELSE 'approve' END AS verdict
  FROM (SELECT DISTINCT review_id FROM changes) r LEFT JOIN counts c USING (review_id)),
outcomes AS (
  SELECT s.*, CASE WHEN error IS NOT NULL THEN 'model_error'
                   WHEN agent = 'performance' AND chunk_index % 9 = 8 THEN 'bad_json' ELSE 'ok' END AS outcome,
         CASE WHEN error IS NOT NULL THEN 0 ELSE cast(floor((prompt_chars + 3) / 4) AS BIGINT) END AS tokens_in_counted
  FROM scored s)
"""
)


@register(
    "chunk_prompt_build",
    _PIPE + "SELECT review_id, chunk_index, n_files, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5 FROM prompts",
)
def q_chunk_prompt_build(spark, sf_dir):
    p = batch(spark, sf_dir).prompts
    return p.select("review_id", "chunk_index", "n_files", F.length("prompt").cast("bigint").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@register(
    "fan_out",
    _PIPE + "SELECT review_id, chunk_index, agent, event_type FROM fanned",
)
def q_fan_out(spark, sf_dir):
    from revlens.operators.score import fan_out

    p = batch(spark, sf_dir).prompts
    return fan_out(p).select("review_id", "chunk_index", "agent", "event_type")


@register(
    "reviewer_config",
    _PIPE + "SELECT agent, default_category, event_type, on_invalid, count(*) AS n_chunks FROM fanned GROUP BY ALL",
)
def q_reviewer_config(spark, sf_dir):
    from revlens.operators.score import fan_out

    p = batch(spark, sf_dir).prompts
    return (
        fan_out(p)
        .groupBy("agent", "default_category", "event_type", "on_invalid")
        .agg(F.count(F.lit(1)).alias("n_chunks"))
    )


@register(
    "model_route_join",
    o.with_views("responses") + f" SELECT review_id, agent, chunk_index, {_MODEL_CASE} AS model_id FROM responses",
)
def q_model_route_join(spark, sf_dir):
    configure(spark)
    r = derived(spark, sf_dir, "responses").select("review_id", "agent", "chunk_index")
    return route_models(r, route_table(spark))


@register(
    "score_chunks",
    _PIPE + "SELECT review_id, chunk_index, agent, model_id, tokens_in_counted AS tokens_in, outcome FROM outcomes",
)
def q_score_chunks(spark, sf_dir):
    d = batch(spark, sf_dir).decoded
    return d.select("review_id", "chunk_index", "agent", "model_id", F.col("tokens_in_counted").alias("tokens_in"), "outcome")


@register(
    "score_retry",
    _PIPE + "SELECT review_id, chunk_index, agent, attempts, waited_s, error FROM scored",
)
def q_score_retry(spark, sf_dir):
    s = batch(spark, sf_dir).scored
    return s.select("review_id", "chunk_index", "agent", F.col("attempts").cast("int"), "waited_s", "error")


@register(
    "dedupe_first_wins",
    _PIPE + "SELECT review_id, file, line, category, source_rank, sk FROM keyed WHERE agent = 'security'",
)
def q_dedupe_first_wins(spark, sf_dir):
    f = batch(spark, sf_dir).findings
    return f.filter(F.col("agent") == "security").select("review_id", "file", "line", "category", "source_rank", "sk")


@register(
    "distinct_files",
    _PIPE.rstrip()
    + """, adds AS (SELECT review_id, coalesce(cast(sum(additions) FILTER (WHERE NOT is_generated) AS BIGINT), 0) AS total_additions
  FROM changes GROUP BY review_id)
SELECT review_id, distinct_files, total_additions FROM verdicts JOIN adds USING (review_id)""",
)
def q_distinct_files(spark, sf_dir):
    b = batch(spark, sf_dir)
    return b.verdicts.select("review_id", "distinct_files").join(b.stats.select("review_id", "total_additions"), "review_id")


@register(
    "review_event_assemble",
    _PIPE
    + """, per AS (SELECT review_id, agent, count(*) AS n_findings, count(*) FILTER (WHERE source_rank = 0) AS n_regex,
                to_json(list({'severity': severity, 'category': category, 'file': file, 'line': line, 'message': message,
                              'suggestion': suggestion, 'agent': agent} ORDER BY source_rank, chunk_index, ordinal, line))::VARCHAR AS findings
              FROM keyed GROUP BY review_id, agent),
stats AS (SELECT review_id, count(*) FILTER (WHERE NOT is_generated) AS files_analyzed FROM changes GROUP BY review_id),
nchunks AS (SELECT review_id, max(total_chunks) AS chunks_analyzed FROM assigned GROUP BY review_id)
SELECT s.review_id, r.agent, CASE WHEN r.agent = 'security' THEN 'review.security' ELSE 'review.' || r.agent END AS event_type,
       coalesce(findings, '[]') AS findings, coalesce(n_findings, 0) AS n_findings, coalesce(n_regex, 0) AS n_regex,
       files_analyzed, coalesce(chunks_analyzed, 0) AS chunks_analyzed, coalesce(tokens_in, 0) AS tokens_in,
       cast(0 AS BIGINT) AS latency_ms, coalesce(model, 'none') AS model, s.review_id AS trace_id
FROM stats s CROSS JOIN reviewers r
LEFT JOIN (SELECT review_id, agent, cast(sum(tokens_in_counted) AS BIGINT) AS tokens_in, max(model_id) AS model FROM outcomes GROUP BY ALL) t
  ON t.review_id = s.review_id AND t.agent = r.agent LEFT JOIN per p ON p.review_id = s.review_id AND p.agent = r.agent
LEFT JOIN nchunks n ON n.review_id = s.review_id""",
)
def q_review_event_assemble(spark, sf_dir):
    from revlens.operators.review_events import assemble_review_events

    b = batch(spark, sf_dir)
    events = assemble_review_events(b.stats, b.chunk_counts, b.findings, b.decoded).drop("tokens_out")
    return events.withColumn("findings", F.to_json("findings", {"ignoreNullFields": "false"}))


@register(
    "token_usage",
    _PIPE
    + """SELECT review_id, agent, model_id, cast(sum(tokens_in_counted) AS BIGINT) AS tokens_in, count(*) AS chunks
FROM outcomes GROUP BY ROLLUP (review_id, agent, model_id)""",
)
def q_token_usage(spark, sf_dir):
    return dash.token_usage(batch(spark, sf_dir).decoded).select("review_id", "agent", "model_id", "tokens_in", "chunks")


@register(
    "review_pipeline_batch",
    _PIPE.rstrip() + comment_tail_sql().replace(
        "SELECT v.review_id, verdict,", "SELECT v.review_id, verdict, n_critical, n_warning, n_info,"
    ),
)
def q_review_pipeline_batch(spark, sf_dir):
    b = batch(spark, sf_dir)
    return b.comments.join(b.verdicts.select("review_id", "n_critical", "n_warning", "n_info"), "review_id")
