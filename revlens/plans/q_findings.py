"""Findings family over stored findings (derived from `events`) and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import code_fence_extract, severity_normalise
from revlens.operators import merge
from revlens.operators.ordering import row_position
from revlens.operators.respond import decode_replies, reply_findings
from revlens.plans import oracle as o
from revlens.plans.registry import register
from revlens.session import configure
from revlens.sources.driver import derived
from revlens.sources.store import reviews_from_events


def keyed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings with their `FINDING#<agent>#<i>` sort keys."""
    configure(spark)
    return merge.assign_finding_keys(derived(spark, sf_dir, "findings_in"), ["ordinal"])


def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.rank_findings(merge.cross_reviewer_dedupe(keyed_findings(spark, sf_dir)))


def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = reviews_from_events(derived(spark, sf_dir, "review_events"))
    return merge.verdicts(reviews, ranked_findings(spark, sf_dir))


# --- oracle building blocks -------------------------------------------------
_KEYED = (
    o.with_views("findings_in", "review_events")
    + """, keyed AS (
  SELECT *, 'FINDING#' || agent || '#' || cast(row_number() OVER (PARTITION BY review_id, agent ORDER BY ordinal) - 1 AS varchar) AS sk
  FROM findings_in),
winners AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY review_id, file, line
                                 ORDER BY CASE WHEN severity = 'critical' THEN 0 ELSE 1 END, sk) AS rn
    FROM keyed) WHERE rn = 1),
ranked AS (
  SELECT *, """
    + o.sev_norm_sql("severity")
    + """ AS bucket,
    CASE """
    + o.sev_norm_sql("severity")
    + """ WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS bucket_rank
  FROM winners),
reviews AS (SELECT DISTINCT review_id FROM review_events),
counts AS (
  SELECT review_id, count(*) FILTER (WHERE bucket = 'critical') AS n_critical,
         count(*) FILTER (WHERE bucket = 'warning') AS n_warning,
         count(*) FILTER (WHERE bucket = 'info') AS n_info,
         count(*) AS total_findings,
         count(DISTINCT CASE WHEN file <> '' THEN file END) AS distinct_files,
         cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS latency_ms
  FROM ranked GROUP BY review_id),
verdicts AS (
  SELECT r.review_id, coalesce(n_critical, 0) AS n_critical, coalesce(n_warning, 0) AS n_warning,
         coalesce(n_info, 0) AS n_info, coalesce(total_findings, 0) AS total_findings,
         cast(coalesce(latency_ms, 0) AS BIGINT) AS latency_ms,
         greatest(1, coalesce(distinct_files, 0)) AS distinct_files,
         CASE WHEN coalesce(n_critical, 0) > 0 THEN 'request_changes'
              WHEN coalesce(n_warning, 0) + coalesce(n_info, 0) > 0 THEN 'comment' ELSE 'approve' END AS verdict
  FROM reviews r LEFT JOIN counts c USING (review_id))
"""
)


@register("finding_key_assign", _KEYED + "SELECT review_id, agent, ordinal, sk FROM keyed")
def q_finding_key_assign(spark, sf_dir):
    return keyed_findings(spark, sf_dir).select("review_id", "agent", "ordinal", "sk")


@register(
    "dedupe_cross_reviewer",
    _KEYED + "SELECT review_id, file, line, sk, agent, severity, category FROM winners",
)
def q_dedupe_cross_reviewer(spark, sf_dir):
    return merge.cross_reviewer_dedupe(keyed_findings(spark, sf_dir)).select(
        "review_id", "file", "line", "sk", "agent", "severity", "category"
    )


@register(
    "rank_by_severity",
    _KEYED
    + "SELECT review_id, sk, bucket, bucket_rank, "
    "row_number() OVER (PARTITION BY review_id ORDER BY bucket_rank, sk) - 1 AS ranked_position FROM ranked",
)
def q_rank_by_severity(spark, sf_dir):
    ranked = ranked_findings(spark, sf_dir).select("review_id", "sk", "bucket", "bucket_rank")
    return row_position(ranked, ["review_id"], ["bucket_rank", "sk"], out="ranked_position")


@register(
    "findings_sorted",
    _KEYED
    + """SELECT review_id, sk, severity,
  CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS sort_rank,
  row_number() OVER (PARTITION BY review_id ORDER BY
    CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, sk) - 1 AS sorted_position
FROM keyed""",
)
def q_findings_sorted(spark, sf_dir):
    ranked = merge.sorted_findings(keyed_findings(spark, sf_dir)).select("review_id", "sk", "severity", "sort_rank")
    return row_position(ranked, ["review_id"], ["sort_rank", "sk"], out="sorted_position")


@register(
    "severity_normalise",
    o.with_views("findings_in")
    + " SELECT ordinal, severity, "
    + o.sev_norm_sql("severity")
    + " AS normalised FROM findings_in",
)
def q_severity_normalise(spark, sf_dir):
    configure(spark)
    f = derived(spark, sf_dir, "findings_in")
    return f.select("ordinal", "severity", severity_normalise(F.col("severity")).alias("normalised"))


@register(
    "severity_counts_review",
    o.with_views("findings_in")
    + """ SELECT review_id, agent,
  count(*) FILTER (WHERE """
    + o.sev_norm_sql("severity")
    + """ = 'critical') AS critical,
  count(*) FILTER (WHERE """
    + o.sev_norm_sql("severity")
    + """ = 'warning') AS warning,
  count(*) FILTER (WHERE """
    + o.sev_norm_sql("severity")
    + """ = 'info') AS info
FROM findings_in GROUP BY review_id, agent""",
)
def q_severity_counts_review(spark, sf_dir):
    configure(spark)
    return merge.reviewer_counts(derived(spark, sf_dir, "findings_in"))


@register(
    "verdict",
    _KEYED + "SELECT review_id, n_critical, n_warning, n_info, verdict FROM verdicts",
)
def q_verdict(spark, sf_dir):
    return review_verdicts(spark, sf_dir).select("review_id", "n_critical", "n_warning", "n_info", "verdict")


@register(
    "commit_status",
    _KEYED
    + """SELECT review_id, verdict,
  CASE WHEN verdict = 'request_changes' THEN 'failure' ELSE 'success' END AS state,
  CASE WHEN verdict = 'request_changes' THEN 'Found ' || cast(n_critical AS varchar) || ' critical issues'
       ELSE 'Review complete: no critical issues' END AS description
FROM verdicts""",
)
def q_commit_status(spark, sf_dir):
    return merge.commit_status(review_verdicts(spark, sf_dir))


@register(
    "review_result",
    _KEYED + "SELECT review_id, verdict, total_findings, latency_ms FROM verdicts",
)
def q_review_result(spark, sf_dir):
    return review_verdicts(spark, sf_dir).select("review_id", "verdict", "total_findings", "latency_ms")


@register(
    "finding_render",
    _KEYED
    + "SELECT review_id, sk, "
    + o.finding_md_sql("severity", "category", "file", "line", "message", "suggestion")
    + " AS md FROM ranked",
)
def q_finding_render(spark, sf_dir):
    return merge.rendered_findings(ranked_findings(spark, sf_dir)).select("review_id", "sk", "md")


def comment_tail_sql() -> str:
    """`, items AS (...) SELECT review_id, verdict, comment` over CTEs named
    `ranked` (with bucket, sk and finding fields) and `verdicts`."""
    from revlens.functions import render as r

    brand = r.DEFAULT_BRAND
    md = o.finding_md_sql("severity", "category", "file", "line", "message", "suggestion")

    def items(b):
        return f"coalesce(string_agg({md} || chr(10), '' ORDER BY sk) FILTER (WHERE bucket = '{b}'), '')"

    def section(n, it, heading, empty, opener):
        body = it if opener is None else f"{o.u(opener)} || {it} || {o.q(r.DETAILS_CLOSE)}"
        return f"{o.u(heading)} || cast({n} AS varchar) || ')' || chr(10) || CASE WHEN {n} > 0 THEN {body} ELSE {o.q(empty)} END"

    banner = (
        f"CASE verdict WHEN 'approve' THEN {o.u(r.BANNER_APPROVE.format(brand=brand))} "
        f"WHEN 'comment' THEN {o.u(r.BANNER_COMMENT.format(brand=brand))} ELSE {o.u(r.BANNER_CHANGES.format(brand=brand))} END"
    )
    nl = "chr(10)"
    text = (
        f"{o.q(r.COMMENT_HEADER.format(brand=brand))} || {nl} || {nl} || {banner} || {nl} || {nl} || '---' || {nl} || {nl}"
        f" || {section('n_critical', 'ci', r.CRITICAL_HEADING, r.NO_CRITICAL, None)}"
        f" || {nl} || '---' || {nl} || {nl} || {section('n_warning', 'wi', r.WARNING_HEADING, r.NO_WARNING, r.WARNING_OPEN)}"
        f" || {nl} || '---' || {nl} || {nl} || {section('n_info', 'ii', r.INFO_HEADING, r.NO_INFO, r.INFO_OPEN)}"
        f" || {nl} || '---' || {nl} || {o.q(r.FOOTER.format(brand=brand))} || cast(distinct_files AS varchar) || ' files (0 additions) in '"
        f" || cast(latency_ms AS varchar) || 'ms.*'"
    )
    return f""", items AS (
  SELECT review_id, {items('critical')} AS ci, {items('warning')} AS wi, {items('info')} AS ii
  FROM ranked GROUP BY review_id)
SELECT v.review_id, verdict, {text} AS comment
FROM verdicts v LEFT JOIN items USING (review_id)"""


def _comment_sql() -> str:
    return _KEYED.rstrip() + comment_tail_sql()


@register("review_comment_render", _comment_sql())
def q_review_comment_render(spark, sf_dir):
    ranked = merge.rendered_findings(ranked_findings(spark, sf_dir))
    reviews = reviews_from_events(derived(spark, sf_dir, "review_events"))
    return merge.review_comments(merge.verdicts(reviews, ranked), ranked)


# A small page, so that most reviews have several; the largest parts are cut.
_PAGE = 300


def _pages_sql() -> str:
    """Next-fit pages over the parts of `comment_tail_sql`'s comment: a recursive walk."""
    from revlens.functions import render as r

    brand, nl = r.DEFAULT_BRAND, "chr(10)"
    md = o.finding_md_sql("severity", "category", "file", "line", "message", "suggestion")

    def heading(n, text, opener, none):
        return f"{o.u(text)} || cast({n} AS varchar) || ')' || {nl} || CASE WHEN {n} > 0 THEN {o.u(opener)} ELSE {o.q(none)} END"

    def close(n):
        return f"CASE WHEN {n} > 0 THEN {o.q(r.DETAILS_CLOSE)} ELSE '' END || {nl} || '---' || {nl}"

    banner = (
        f"CASE verdict WHEN 'approve' THEN {o.u(r.BANNER_APPROVE.format(brand=brand))} "
        f"WHEN 'comment' THEN {o.u(r.BANNER_COMMENT.format(brand=brand))} ELSE {o.u(r.BANNER_CHANGES.format(brand=brand))} END"
    )
    rule = f"{nl} || '---' || {nl} || {nl} || "
    frames = [
        f"{o.q(r.COMMENT_HEADER.format(brand=brand))} || {nl} || {nl} || {banner} || {nl} || {rule}{heading('n_critical', r.CRITICAL_HEADING, '', r.NO_CRITICAL)}",
        f"{rule}{heading('n_warning', r.WARNING_HEADING, r.WARNING_OPEN, r.NO_WARNING)}",
        f"{close('n_warning')} || {nl} || {heading('n_info', r.INFO_HEADING, r.INFO_OPEN, r.NO_INFO)}",
        f"{close('n_info')} || {o.q(r.FOOTER.format(brand=brand))} || cast(distinct_files AS varchar) || ' files (0 additions) in ' || cast(latency_ms AS varchar) || 'ms.*'",
    ]
    framed = " UNION ALL ".join(f"SELECT review_id, {2 * i} AS section, '' AS sk, {t} AS text FROM verdicts" for i, t in enumerate(frames))
    width = _PAGE // 4
    return (
        _KEYED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
        + f""", parts AS ({framed}
  UNION ALL SELECT review_id, 2 * bucket_rank + 1, sk, {md} || {nl} FROM ranked SEMI JOIN verdicts USING (review_id)),
pieces AS (
  SELECT review_id, section, sk, piece,
         CASE WHEN strlen(text) > {_PAGE} THEN substring(text, cast(piece * {width} + 1 AS INT), {width}) ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN strlen(text) > {_PAGE} THEN (length(text) - 1) // {width} + 1 ELSE 1 END)) AS piece
        FROM parts WHERE text IS NOT NULL)),
placed AS (
  SELECT review_id, text, strlen(text) AS bytes, row_number() OVER (PARTITION BY review_id ORDER BY section, sk, piece) AS rn FROM pieces),
walk AS (
  SELECT review_id, rn, bytes AS cur, 0 AS page, text FROM placed WHERE rn = 1
  UNION ALL
  SELECT p.review_id, p.rn, CASE WHEN w.cur + p.bytes > {_PAGE} THEN p.bytes ELSE w.cur + p.bytes END,
         CASE WHEN w.cur + p.bytes > {_PAGE} THEN w.page + 1 ELSE w.page END, p.text
  FROM walk w JOIN placed p ON p.review_id = w.review_id AND p.rn = w.rn + 1)
SELECT review_id, cast(page AS BIGINT) AS page, cast(max(max(page)) OVER (PARTITION BY review_id) + 1 AS BIGINT) AS pages,
  string_agg(text, '' ORDER BY rn) AS text
FROM walk GROUP BY review_id, page"""
    )


@register("review_comment_pages", _pages_sql())
def q_review_comment_pages(spark, sf_dir):
    """The comments of `review_comment_render` in pages: no row holds a review."""
    ranked = merge.rendered_findings(ranked_findings(spark, sf_dir))
    reviews = reviews_from_events(derived(spark, sf_dir, "review_events"))
    return merge.comment_pages(merge.verdicts(reviews, ranked), ranked, page_bytes=_PAGE)


# --- model replies -----------------------------------------------------------
def decoded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return decode_replies(derived(spark, sf_dir, "responses"))


@register(
    "code_fence_extract",
    o.with_views("responses") + " SELECT review_id, agent, chunk_index, " + o.fence_sql("text") + " AS json_text FROM responses",
)
def q_code_fence_extract(spark, sf_dir):
    configure(spark)
    r = derived(spark, sf_dir, "responses")
    return r.select("review_id", "agent", "chunk_index", code_fence_extract(F.col("text")).alias("json_text"))


def _replies_sql() -> str:
    js = o.fence_sql("text")

    def str_ok(e, name):
        return f"coalesce(json_type({e}, '$.{name}') = 'VARCHAR', true)"

    def line_val(e):
        t = f"json_type({e}, '$.line')"
        s = f"json_extract_string({e}, '$.line')"
        return (
            f"CASE WHEN {t} IS NULL THEN 0 WHEN {t} IN ('BIGINT', 'UBIGINT') THEN cast({s} AS BIGINT) "
            f"WHEN {t} = 'DOUBLE' AND cast({s} AS DOUBLE) = floor(cast({s} AS DOUBLE)) THEN cast(cast({s} AS DOUBLE) AS BIGINT) "
            f"WHEN {t} = 'VARCHAR' AND regexp_full_match({s}, '\\s*[+-]?[0-9]+\\s*') THEN cast(trim({s}) AS BIGINT) "
            f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {s} = 'true' THEN 1 ELSE 0 END END"
        )

    e = "e"
    ok = (
        f"(json_type({e}) = 'OBJECT' AND {str_ok(e, 'severity')} AND {str_ok(e, 'category')} AND {str_ok(e, 'file')}"
        f" AND {str_ok(e, 'message')} AND {str_ok(e, 'suggestion')} AND ({line_val(e)}) IS NOT NULL)"
    )
    default_cat = "CASE agent WHEN 'security' THEN 'other' WHEN 'performance' THEN 'performance' WHEN 'style' THEN 'style' ELSE 'test' END"
    return (
        o.with_views("responses")
        + f""", base AS (
  SELECT *, {js} AS js FROM responses),
typed AS (
  SELECT *, CASE WHEN json_valid(js) THEN json_type(js) END AS top,
         CASE WHEN json_valid(js) THEN json_type(js, '$.findings') END AS ftype
  FROM base),
shaped AS (
  SELECT *, (top IS NULL OR (top = 'OBJECT' AND NOT ends_with(js, '}}')) OR (top = 'ARRAY' AND NOT ends_with(js, ']'))) AS bad_json,
         (top = 'OBJECT' AND (ftype IS NULL OR ftype = 'ARRAY')) AS shape_ok,
         CASE WHEN ftype = 'ARRAY' THEN json_array_length(js, '$.findings') ELSE 0 END AS n_el
  FROM typed),
elems AS (
  SELECT review_id, agent, chunk_index, i AS pos, json_extract(js, '$.findings[' || i || ']') AS e
  FROM (SELECT *, unnest(range(CAST(n_el AS BIGINT))) AS i FROM shaped WHERE NOT bad_json)),
checked AS (
  SELECT *, {ok} AS ok FROM elems),
first_bad AS (
  SELECT review_id, agent, chunk_index, min(pos) FILTER (WHERE NOT ok) AS fb FROM checked GROUP BY ALL),
outcomes AS (
  SELECT s.*, fb,
    CASE WHEN bad_json THEN 'bad_json' WHEN NOT shape_ok OR fb IS NOT NULL THEN 'invalid' ELSE 'ok' END AS outcome
  FROM shaped s LEFT JOIN first_bad USING (review_id, agent, chunk_index)),
findings AS (
  SELECT c.review_id, c.agent, c.chunk_index, c.pos,
    {o.sev_norm_sql("coalesce(json_extract_string(e, '$.severity'), 'INFO')")} AS severity,
    coalesce(json_extract_string(e, '$.category'), {default_cat}) AS category,
    coalesce(json_extract_string(e, '$.file'), 'unknown') AS file,
    {line_val('e')} AS line,
    coalesce(json_extract_string(e, '$.message'), '') AS message,
    coalesce(json_extract_string(e, '$.suggestion'), '') AS suggestion
  FROM checked c JOIN outcomes u USING (review_id, agent, chunk_index)
  WHERE u.outcome = 'ok' OR (u.outcome = 'invalid' AND u.agent <> 'security' AND u.shape_ok AND c.pos < u.fb))
"""
    )


@register(
    "findings_parse",
    _replies_sql() + "SELECT * FROM findings",
)
def q_findings_parse(spark, sf_dir):
    return reply_findings(decoded_replies(spark, sf_dir))


@register(
    "score_error_isolation",
    _replies_sql()
    + """SELECT review_id, agent, chunk_index, outcome,
  CASE WHEN outcome = 'invalid' AND agent = 'security' THEN 0 ELSE tokens_in END AS tokens_in_counted,
  CASE WHEN outcome = 'invalid' AND agent = 'security' THEN 0 ELSE tokens_out END AS tokens_out_counted,
  (SELECT count(*) FROM findings f WHERE f.review_id = o.review_id AND f.agent = o.agent AND f.chunk_index = o.chunk_index) AS n_findings
FROM outcomes o""",
)
def q_score_error_isolation(spark, sf_dir):
    d = decoded_replies(spark, sf_dir)
    return d.select(
        "review_id", "agent", "chunk_index", "outcome", "tokens_in_counted", "tokens_out_counted",
        F.size("findings").cast("bigint").alias("n_findings"),
    )
