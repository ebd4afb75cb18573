"""Parser family: language, status, generated filter, stats, chunks, secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.paths import map_file_status
from revlens.operators.chunk import chunk_table, number_files
from revlens.operators.parse import drop_generated, file_changes, pr_stats
from revlens.operators.scan import patch_lines, secret_scan
from revlens.plans.oracle import kept_changes_sql, secret_findings_sql, with_views
from revlens.plans.registry import register
from revlens.session import configure
from revlens.sources.driver import derived


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return file_changes(derived(spark, sf_dir, "pr_files"))


_CHANGES = with_views("pr_files") + f", changes AS ({kept_changes_sql()})\n"


@register(
    "detect_language",
    _CHANGES + "SELECT review_id, ordinal, path, language FROM changes",
)
def q_detect_language(spark, sf_dir):
    return changes(spark, sf_dir).select("review_id", "ordinal", "path", "language")


@register(
    "map_file_status",
    with_views("pr_files") + ", changes AS (" + kept_changes_sql() + ")\n"
    "SELECT c.review_id, c.ordinal, p.status AS raw_status, c.status FROM changes c JOIN pr_files p USING (review_id, ordinal)",
)
def q_map_file_status(spark, sf_dir):
    configure(spark)
    raw = derived(spark, sf_dir, "pr_files")
    return raw.select("review_id", "ordinal", F.col("status").alias("raw_status"), map_file_status(F.col("status")).alias("status"))


@register(
    "file_change_project",
    _CHANGES
    + "SELECT review_id, ordinal, path, language, status, additions, deletions, length(patch) AS patch_chars, "
    "md5(patch) AS patch_md5, source_path FROM changes WHERE NOT is_generated",
)
def q_file_change_project(spark, sf_dir):
    return drop_generated(changes(spark, sf_dir)).select(
        "review_id", "ordinal", "path", "language", "status", "additions", "deletions",
        F.length("patch").cast("bigint").alias("patch_chars"), F.md5("patch").alias("patch_md5"), "source_path",
    )


@register(
    "generated_file_filter",
    _CHANGES + "SELECT review_id, count(*) FILTER (WHERE NOT is_generated) AS kept_files, "
    "count(*) FILTER (WHERE is_generated) AS generated_files FROM changes GROUP BY review_id",
)
def q_generated_file_filter(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("review_id").agg(
        F.count_if(~F.col("is_generated")).alias("kept_files"),
        F.count_if(F.col("is_generated")).alias("generated_files"),
    )


@register(
    "pr_stats",
    _CHANGES
    + """SELECT review_id,
  count(*) FILTER (WHERE NOT is_generated) AS total_files,
  cast(coalesce(sum(additions) FILTER (WHERE NOT is_generated), 0) AS BIGINT) AS total_additions,
  cast(coalesce(sum(deletions) FILTER (WHERE NOT is_generated), 0) AS BIGINT) AS total_deletions,
  coalesce(array_to_string(list_sort(list_distinct(list(language) FILTER (WHERE NOT is_generated AND language <> 'unknown'))), ','), '') AS languages,
  count(*) FILTER (WHERE is_generated) > 0 AS has_generated_files,
  count(*) FILTER (WHERE is_generated) AS generated_files_filtered
FROM changes GROUP BY review_id""",
)
def q_pr_stats(spark, sf_dir):
    return pr_stats(changes(spark, sf_dir)).withColumn("languages", F.array_join("languages", ","))


@register(
    "added_line_filter",
    _CHANGES
    + """SELECT review_id, count(*) AS added_lines, count(DISTINCT ordinal) AS files_with_added,
  cast(sum(length(text)) AS BIGINT) AS added_chars
FROM (SELECT review_id, ordinal, unnest(string_split(patch, chr(10))) AS text
      FROM changes WHERE NOT is_generated AND patch <> '')
WHERE starts_with(text, '+') GROUP BY review_id""",
)
def q_added_line_filter(spark, sf_dir):
    lines = patch_lines(drop_generated(changes(spark, sf_dir)))
    return lines.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("added_lines"),
        F.countDistinct("ordinal").alias("files_with_added"),
        F.sum(F.length("text")).cast("bigint").alias("added_chars"),
    )


@register(
    "secret_scan",
    _CHANGES + "SELECT review_id, ordinal, severity, category, file, line, message, suggestion, agent FROM ("
    + secret_findings_sql()
    + ")",
)
def q_secret_scan(spark, sf_dir):
    return secret_scan(drop_generated(changes(spark, sf_dir))).drop("rule_index")


_CHUNK_SQL = (
    _CHANGES
    + """, kept AS (
  SELECT review_id, ordinal, additions + deletions AS lines,
         row_number() OVER (PARTITION BY review_id ORDER BY ordinal) AS rn
  FROM changes WHERE NOT is_generated),
walk AS (
  WITH RECURSIVE w(review_id, rn, ordinal, cur, chunk_index) AS (
    SELECT review_id, rn, ordinal, lines, 0 FROM kept WHERE rn = 1
    UNION ALL
    SELECT k.review_id, k.rn, k.ordinal,
           CASE WHEN w.cur + k.lines > 500 THEN k.lines ELSE w.cur + k.lines END,
           CASE WHEN w.cur + k.lines > 500 THEN w.chunk_index + 1 ELSE w.chunk_index END
    FROM w JOIN kept k ON k.review_id = w.review_id AND k.rn = w.rn + 1)
  SELECT * FROM w),
assigned AS (
  SELECT w.review_id, w.ordinal, cast(w.chunk_index AS BIGINT) AS chunk_index,
         cast(max(w.chunk_index) OVER (PARTITION BY w.review_id) + 1 AS BIGINT) AS total_chunks, k.lines
  FROM walk w JOIN kept k USING (review_id, ordinal))
"""
)


@register(
    "chunk_pack",
    _CHUNK_SQL
    + """SELECT review_id, chunk_index, max(total_chunks) AS total_chunks,
  cast(sum(lines) AS BIGINT) AS total_lines, count(*) AS n_files
FROM assigned GROUP BY review_id, chunk_index""",
)
def q_chunk_pack(spark, sf_dir):
    kept = drop_generated(changes(spark, sf_dir))
    return chunk_table(kept)


@register(
    "chunk_assign",
    _CHUNK_SQL + "SELECT review_id, ordinal, chunk_index, total_chunks FROM assigned",
)
def q_chunk_assign(spark, sf_dir):
    kept = drop_generated(changes(spark, sf_dir))
    lines = (F.col("additions") + F.col("deletions")).alias("lines")
    return number_files(kept.select("review_id", "ordinal", lines)).drop("lines")
