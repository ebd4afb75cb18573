"""DuckDB formulations of the operators, used as the correctness oracle.

These are independent SQL restatements of each operator (windows, recursive
CTEs and plain aggregates), built from the same fixed-value tables in
`revlens.rules`. They run on the benchmark tables registered as views.
"""

from __future__ import annotations

from revlens import rules
from revlens.functions import render
from revlens.sources.driver import derived_sql


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def u(s: str) -> str:
    """SQL string literal for text with non-ASCII characters (kept verbatim)."""
    return q(s)


def views_cte(*names: str) -> str:
    """CTE list defining the derived inputs `names` (DuckDB dialect)."""
    return ",\n".join(f"{n} AS ({derived_sql(n, 'duckdb')})" for n in names)


def with_views(*names: str) -> str:
    """`WITH` prefix defining the derived inputs `names` (DuckDB dialect)."""
    return "WITH " + views_cte(*names)


def language_sql(path: str) -> str:
    lower = f"lower({path})"
    ext = f"regexp_extract({lower}, '[^/.][^/]*(\\.[^/.]*)$', 1)"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.LANGUAGE_BY_EXTENSION.items())
    return (
        f"CASE WHEN ends_with({lower}, 'dockerfile') OR starts_with({lower}, 'dockerfile') THEN 'dockerfile' "
        f"WHEN ends_with({lower}, 'makefile') THEN 'makefile' "
        f"ELSE CASE {ext} {cases} ELSE 'unknown' END END"
    )


def generated_sql(path: str) -> str:
    return "(" + " OR ".join(f"contains(lower({path}), {q(m)})" for m in rules.GENERATED_FILE_MARKERS) + ")"


def status_sql(status: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.FILE_STATUS_MAP.items())
    return f"CASE {status} {cases} ELSE {q(rules.DEFAULT_FILE_STATUS)} END"


def secret_index_sql(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, {q(p)}) THEN {i}" for i, (_, p, _) in enumerate(rules.SECRET_RULES)
    )
    return f"CASE {cases} END"


def secret_name_sql(idx: str) -> str:
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN {q(n)}" for i, (n, _, _) in enumerate(rules.SECRET_RULES)) + " END"


def secret_sev_sql(idx: str) -> str:
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN {q(s)}" for i, (_, _, s) in enumerate(rules.SECRET_RULES)) + " END"


def strip_sql(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def fence_sql(text: str) -> str:
    s = strip_sql(text)
    return strip_sql(
        f"CASE WHEN contains({s}, '```json') THEN regexp_extract(regexp_extract({s}, '(?s)```json(.*?)(?:```json|\\z)', 1), '(?s)^(.*?)(?:```|\\z)', 1) "
        f"WHEN contains({s}, '```') THEN regexp_extract({s}, '(?s)```(.*?)(?:```|\\z)', 1) ELSE {s} END"
    )


def sev_norm_sql(sev: str) -> str:
    return f"CASE WHEN lower({sev}) IN ('critical', 'warning', 'info') THEN lower({sev}) ELSE 'info' END"


def title_sql(s: str) -> str:
    marked = f"regexp_replace({s}, '([-\\s(\\{{\\[<])', '\\1' || chr(1), 'g')"
    return f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda p: upper(p[1:1]) || lower(p[2:])), '')"


def line_suffix_sql(line: str, prefix: str, suffix: str = "") -> str:
    return f"CASE WHEN {line} IS NOT NULL AND {line} <> 0 THEN {q(prefix)} || cast({line} as varchar) || {q(suffix)} ELSE '' END"


def _sql_text(text: str) -> str:
    """SQL expression for `text`, newlines as chr(10)."""
    parts = text.split("\n")
    return " || chr(10) || ".join(q(p) for p in parts) if len(parts) > 1 else q(text)


def finding_md_sql(sev: str, cat: str, file: str, line: str, msg: str, sug: str) -> str:
    r = render
    s = f"lower(coalesce({sev}, 'info'))"
    t = title_sql(cat)
    crit = (
        f"{_sql_text(r.CRITICAL_ITEM_PREFIX)} || {t} || '] ' || {file} || {line_suffix_sql(line, ' (Line ', ')')}"
        f" || chr(10) || {msg} || {_sql_text(r.CRITICAL_ITEM_RECOMMENDATION)} || {sug}"
    )
    coll = (
        f"{_sql_text(r.COLLAPSIBLE_OPEN)} || {t} || {_sql_text(r.COLLAPSIBLE_TITLE_CLOSE)} || {file}"
        f" || {line_suffix_sql(line, ': Line ')} || {_sql_text(r.COLLAPSIBLE_SUMMARY_CLOSE)} || {msg}"
        f" || {_sql_text(r.COLLAPSIBLE_SUGGESTION_OPEN)} || {sug} || {_sql_text(r.COLLAPSIBLE_CLOSE)}"
    )
    fb = f"{_sql_text(r.FALLBACK_OPEN)} || {cat} || {_sql_text(r.FALLBACK_SEPARATOR)} || {msg}"
    return f"CASE WHEN {s} = 'critical' THEN {crit} WHEN {s} IN ('warning', 'info') THEN {coll} ELSE {fb} END"


def kept_changes_sql() -> str:
    """Typed file changes over derived pr_files (DuckDB)."""
    return f"""
SELECT review_id, ordinal, filename AS path, {language_sql('filename')} AS language,
       {status_sql('status')} AS status, coalesce(additions, 0) AS additions,
       coalesce(deletions, 0) AS deletions, coalesce(patch, '') AS patch,
       previous_filename AS source_path, {generated_sql('filename')} AS is_generated
FROM pr_files"""


def secret_findings_sql() -> str:
    """Secret findings over kept changes (needs CTE `changes`)."""
    return f"""
SELECT review_id, ordinal, {secret_sev_sql('rule_index')} AS severity, 'hardcoded_secret' AS category,
       path AS file, cast(line_no AS BIGINT) AS line,
       {secret_name_sql('rule_index')} || {q(rules.SECRET_MESSAGE_SUFFIX)} AS message,
       {q(rules.SECRET_SUGGESTION)} AS suggestion, 'security' AS agent, rule_index
FROM (
  SELECT *, {secret_index_sql('text')} AS rule_index
  FROM (
    SELECT review_id, ordinal, path, unnest(l) AS text, generate_subscripts(l, 1) AS line_no
    FROM (SELECT *, string_split(patch, chr(10)) AS l FROM changes WHERE NOT is_generated AND patch <> '')
  ) WHERE starts_with(text, '+')
) WHERE rule_index IS NOT NULL"""
