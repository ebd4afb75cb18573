"""Deduplication, ranking, verdict, commit status and review comments.

All "first occurrence wins" rules are `min(struct(order..., payload...))`
aggregates (see `ordering.first_by_order`): Spark combines them partially on
the map side, so a hot review or a hot (file, line) never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import rules
from revlens.functions.render import DEFAULT_BRAND, comment_frame, finding_markdown, review_comment_parts
from revlens.functions.text import severity_normalise
from revlens.operators.chunk import number_files
from revlens.operators.ordering import first_by_order, row_position
from revlens.session import materialise

FINDING_FIELDS = ["severity", "category", "file", "line", "message", "suggestion", "agent"]
#: Bytes of a page of a comment: the hosting service takes 65,536 characters.
PAGE_BYTES = 60_000


def security_dedupe(findings: DataFrame) -> DataFrame:
    """Security reviewer: one finding per (review_id, file, line, category),
    the first by (source_rank, chunk_index, ordinal); regex findings have
    source_rank 0 and precede model findings (source_rank 1). Line is part of
    the key, so it need not be part of the order."""
    return first_by_order(
        findings, ["review_id", "file", "line", "category"], ["source_rank", "chunk_index", "ordinal"]
    )


def assign_finding_keys(findings: DataFrame, order: list[str], materialise_input: bool = False) -> DataFrame:
    """Store keys `FINDING#<agent>#<i>`: i is 0-based per (review, agent) in
    `order`, unpadded, so '#10' sorts before '#2' as a string. Adds `finding_no`
    and `sk`. Numbering is skew-safe (`row_position`)."""
    numbered = row_position(
        findings, ["review_id", "agent"], order, out="finding_no", materialise_input=materialise_input
    )
    return numbered.withColumn(
        "sk", F.concat(F.lit("FINDING#"), F.col("agent"), F.lit("#"), F.col("finding_no").cast("string"))
    )


def cross_reviewer_dedupe(findings: DataFrame) -> DataFrame:
    """Across reviewers: one finding per (review_id, file, line) - category is
    not part of the key. Walking the review's findings in `sk` order, the
    first one wins, except that the first finding whose severity is exactly
    'critical' displaces a non-critical winner (an earlier info or warning is
    never displaced by a warning). Output order is the winner's `sk`.
    """
    not_critical = F.when(F.col("severity") == "critical", F.lit(1)).otherwise(F.lit(0))
    keyed = findings.withColumn("__nc", 1 - not_critical)
    winners = first_by_order(keyed, ["review_id", "file", "line"], ["__nc", "sk"])
    return winners.drop("__nc")


def rank_findings(deduped: DataFrame) -> DataFrame:
    """Severity bucket (case-insensitive; unknown -> info) and the bucket
    rank 0/1/2, stable by `sk` inside a bucket."""
    bucket = severity_normalise(F.col("severity"))
    rank_map = F.create_map(*[F.lit(x) for kv in rules.SEVERITY_RANK.items() for x in kv])
    return deduped.withColumn("bucket", bucket).withColumn("bucket_rank", F.element_at(rank_map, bucket))


def verdicts(reviews: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per review: counts per bucket and the verdict. Starts from `reviews`
    (left join), so a review without findings approves."""
    if "ts" in ranked.columns:
        # elapsed time between the first and last finding, truncated to ms
        latency = F.floor(
            (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp"))))
            / 1000
        ).cast("bigint")
    else:
        latency = F.lit(0).cast("bigint")
    counts = ranked.groupBy("review_id").agg(
        F.count_if(F.col("bucket") == "critical").alias("n_critical"),
        F.count_if(F.col("bucket") == "warning").alias("n_warning"),
        F.count_if(F.col("bucket") == "info").alias("n_info"),
        F.count(F.lit(1)).alias("total_findings"),
        F.count_distinct(F.when(F.col("file") != "", F.col("file"))).alias("distinct_files"),
        latency.alias("latency_ms"),
    )
    out = reviews.select("review_id").join(counts, "review_id", "left")
    zero = F.lit(0).cast("bigint")
    out = out.select(
        "review_id",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ["n_critical", "n_warning", "n_info", "total_findings", "latency_ms"]],
        F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.col("distinct_files"), zero)).alias("distinct_files"),
    )
    return out.withColumn(
        "verdict",
        F.when(F.col("n_critical") > 0, F.lit("request_changes"))
        .when((F.col("n_warning") + F.col("n_info")) > 0, F.lit("comment"))
        .otherwise(F.lit("approve")),
    )


def commit_status(verdict_df: DataFrame) -> DataFrame:
    """failure iff changes are requested; a one-line description."""
    return verdict_df.select(
        "review_id",
        "verdict",
        F.when(F.col("verdict") == "request_changes", F.lit("failure")).otherwise(F.lit("success")).alias("state"),
        F.when(
            F.col("verdict") == "request_changes",
            F.concat(F.lit("Found "), F.col("n_critical").cast("string"), F.lit(" critical issues")),
        )
        .otherwise(F.lit("Review complete: no critical issues"))
        .alias("description"),
    )


def rendered_findings(ranked: DataFrame) -> DataFrame:
    """Each ranked finding with its Markdown partial (`md`)."""
    return ranked.withColumn(
        "md",
        finding_markdown(
            F.col("severity"), F.col("category"), F.col("file"), F.col("line"), F.col("message"), F.col("suggestion")
        ),
    )


def review_comments(verdict_df: DataFrame, rendered: DataFrame, brand: str = DEFAULT_BRAND) -> DataFrame:
    """The full comment per review.

    The partials of a bucket are concatenated in `sk` order. This is the one
    place where a review's findings meet in one row: the comment *is* one
    string. `comment_pages` gives the same text in pages of a stated size, and
    no row of it holds a review.
    """
    items = rendered.groupBy("review_id").agg(
        *[
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct(F.col("sk"), F.col("md"))))),
                    lambda s: F.concat(s["md"], F.lit("\n")),
                ),
                "",
            ).alias(f"{b}_items")
            for b in rules.SEVERITIES
        ]
    )
    joined = verdict_df.join(items, "review_id", "left")
    empty = F.lit("")
    return joined.select(
        "review_id",
        "verdict",
        review_comment_parts(
            F.col("verdict"),
            F.col("n_critical"),
            F.coalesce(F.col("critical_items"), empty),
            F.col("n_warning"),
            F.coalesce(F.col("warning_items"), empty),
            F.col("n_info"),
            F.coalesce(F.col("info_items"), empty),
            F.col("distinct_files"),
            F.lit(0),
            F.col("latency_ms"),
            brand=brand,
        ).alias("comment"),
    )


def comment_parts(verdict_df: DataFrame, rendered: DataFrame, brand: str = DEFAULT_BRAND) -> DataFrame:
    """The comment of each review in `verdict_df` as rows (review_id, section, sk, text):
    heading, findings and footer, which joined by (section, sk) give `review_comments`.
    A finding without text is no part, as it leaves nothing in the comment."""
    frame = comment_frame(
        F.col("verdict"), F.col("n_critical"), F.col("n_warning"), F.col("n_info"), F.col("distinct_files"), F.lit(0), F.col("latency_ms"),
        brand=brand,
    )
    frames = verdict_df.select(
        "review_id",
        F.inline(F.array(*[F.struct(F.lit(2 * i).alias("section"), F.lit("").alias("sk"), t.alias("text")) for i, t in enumerate(frame)])),
    )
    items = rendered.where(F.col("md").isNotNull()).join(verdict_df.select("review_id"), "review_id", "left_semi")
    return frames.unionByName(
        items.select("review_id", (2 * F.col("bucket_rank") + 1).cast("int").alias("section"), "sk", F.concat("md", F.lit("\n")).alias("text"))
    )


def comment_pages(verdict_df: DataFrame, rendered: DataFrame, page_bytes: int = PAGE_BYTES, brand: str = DEFAULT_BRAND) -> DataFrame:
    """The comment of each review in pages of at most `page_bytes` UTF-8 bytes: review_id,
    page (from 0), pages, text. The pages joined in order are the comment of
    `review_comments`. Parts are packed in order (`number_files`, by bytes instead of lines),
    so a finding stands on one page, unless it is larger than a page itself: then it is cut.

    Only (review_id, section, sk, piece, bytes) is numbered; texts move once to their place
    in a page and meet there. No row and no group holds more than a page.
    """
    if page_bytes < 4:
        raise ValueError("a page holds one code point at least: page_bytes >= 4")
    width = page_bytes // 4  # code points that fit for certain
    text = F.col("text")
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int")),
        lambda i: F.substring(text, i * width + 1, F.lit(width)),
    )
    pieces = F.when(F.octet_length(text) > page_bytes, cut).otherwise(F.array(text))
    place = ["review_id", "section", "sk", "piece"]
    parts = comment_parts(verdict_df, rendered, brand).select("review_id", "section", "sk", F.posexplode_outer(pieces).alias("piece", "text"))
    slim = materialise(parts.select(*place, F.octet_length("text").cast("bigint").alias("lines")))
    placed = row_position(slim, ["review_id"], place[1:], out="ordinal")
    numbered = number_files(placed.select("review_id", "ordinal", "lines"), page_bytes).drop("lines")
    paged = parts.join(placed.drop("lines").join(numbered, ["review_id", "ordinal"]), place)
    return paged.groupBy("review_id", F.col("chunk_index").alias("page")).agg(
        F.max("total_chunks").alias("pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda p: p["text"]), "").alias("text"),
    )


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Drill-down order: critical < warning < info < anything else (rank 3),
    case-sensitive, stable by `sk`. Adds `sort_rank`; a global range-sorted
    orderBy, no single-task window."""
    rank_map = F.create_map(*[F.lit(x) for kv in rules.SEVERITY_RANK.items() for x in kv])
    ranked = findings.withColumn(
        "sort_rank", F.coalesce(F.try_element_at(rank_map, F.col("severity")), F.lit(rules.OTHER_SEVERITY_RANK))
    )
    return ranked.orderBy("review_id", "sort_rank", "sk")


def reviewer_counts(findings: DataFrame) -> DataFrame:
    """Per review and reviewer: normalised severity counts."""
    sev = severity_normalise(F.col("severity"))
    return findings.groupBy("review_id", "agent").agg(
        F.count_if(sev == "critical").alias("critical"),
        F.count_if(sev == "warning").alias("warning"),
        F.count_if(sev == "info").alias("info"),
    )


__all__ = [
    "FINDING_FIELDS",
    "assign_finding_keys",
    "comment_pages",
    "comment_parts",
    "commit_status",
    "cross_reviewer_dedupe",
    "rank_findings",
    "rendered_findings",
    "review_comments",
    "reviewer_counts",
    "security_dedupe",
    "sorted_findings",
    "verdicts",
]
