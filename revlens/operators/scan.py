"""Regex secret scan over the added lines of every patch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import rules
from revlens.functions.secrets import secret_candidate, secret_rule_index, secret_rule_name, secret_rule_severity


def patch_lines(changes: DataFrame, added_only: bool = True) -> DataFrame:
    """One row per patch line: review_id, ordinal, path, line_no (1-based
    within the patch, hunk headers included), text.

    The whole patch is split; nothing is truncated. `posexplode_outer` and
    filters on the generated `text` keep the patch expression out of filters
    pushed below the generator (a plain explode infers `size(...) > 0` and
    pushes it down to the scan). Splitting '' gives one empty line, which
    is not an added line; with `added_only=False` empty patches are dropped
    explicitly.
    """
    lines = changes.select(
        "review_id", "ordinal", "path", F.length("patch").alias("__patch_len"),
        F.posexplode_outer(F.split(F.col("patch"), "\n")).alias("pos", "text"),
    )
    keep = F.col("text").startswith("+") if added_only else (F.col("__patch_len") > 0) & F.col("pos").isNotNull()
    return lines.filter(keep).select("review_id", "ordinal", "path", (F.col("pos") + 1).alias("line_no"), "text")


def secret_scan(changes: DataFrame) -> DataFrame:
    """Findings for added lines that match a secret rule; at most one per line
    (the first rule in order). Row-local: no shuffle.

    Output: review_id, ordinal, severity, category, file, line, message,
    suggestion, agent, rule_index.
    """
    candidates = patch_lines(changes).filter(secret_candidate(F.col("text")))
    hits = candidates.withColumn("rule_index", secret_rule_index(F.col("text"))).filter(F.col("rule_index").isNotNull())
    return hits.select(
        "review_id",
        "ordinal",
        secret_rule_severity(F.col("rule_index")).alias("severity"),
        F.lit(rules.SECRET_CATEGORY).alias("category"),
        F.col("path").alias("file"),
        F.col("line_no").cast("bigint").alias("line"),
        F.concat(secret_rule_name(F.col("rule_index")), F.lit(rules.SECRET_MESSAGE_SUFFIX)).alias("message"),
        F.lit(rules.SECRET_SUGGESTION).alias("suggestion"),
        F.lit("security").alias("agent"),
        "rule_index",
    )
