"""Changed-file parsing: typed file changes, generated-file filter, PR stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.paths import detect_language, is_generated_file, map_file_status


def file_changes(pr_files: DataFrame) -> DataFrame:
    """Hosting-service file rows -> typed file changes (all rows kept).

    Input columns: review_id, ordinal, filename, status, additions, deletions,
    patch, previous_filename. Adds `is_generated`; missing counts become 0 and
    a missing patch "".
    """
    return pr_files.select(
        "review_id",
        "ordinal",
        F.col("filename").alias("path"),
        detect_language(F.col("filename")).alias("language"),
        map_file_status(F.col("status")).alias("status"),
        F.coalesce(F.col("additions"), F.lit(0)).cast("bigint").alias("additions"),
        F.coalesce(F.col("deletions"), F.lit(0)).cast("bigint").alias("deletions"),
        F.coalesce(F.col("patch"), F.lit("")).alias("patch"),
        F.col("previous_filename").alias("source_path"),
        is_generated_file(F.col("filename")).alias("is_generated"),
    )


def drop_generated(changes: DataFrame) -> DataFrame:
    """Keep files that are not generated (the filter pushes into the scan's
    projection; nothing downstream sees generated files)."""
    return changes.filter(~F.col("is_generated"))


def pr_stats(changes: DataFrame) -> DataFrame:
    """Per review: counts over kept files, sorted distinct known languages,
    and how many generated files were filtered.

    Aggregates *all* rows (generated included) so an all-generated PR still
    yields a row. One partial (map-side) aggregation: a hot review is combined
    on every task before the shuffle; the language set is bounded by the
    35-entry map.
    """
    kept = ~F.col("is_generated")
    return changes.groupBy("review_id").agg(
        F.count_if(kept).alias("total_files"),
        F.coalesce(F.sum(F.when(kept, F.col("additions"))), F.lit(0)).cast("bigint").alias("total_additions"),
        F.coalesce(F.sum(F.when(kept, F.col("deletions"))), F.lit(0)).cast("bigint").alias("total_deletions"),
        F.array_sort(
            F.collect_set(F.when(kept & (F.col("language") != "unknown"), F.col("language")))
        ).alias("languages"),
        (F.count_if(F.col("is_generated")) > 0).alias("has_generated_files"),
        F.count_if(F.col("is_generated")).alias("generated_files_filtered"),
    )
