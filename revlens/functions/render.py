"""Markdown rendering of findings and review comments with native string functions.

The text layout reproduces the original templates as rendered with
block-trimming on (block tags leave no blank line, the final newline is
dropped). The product name in the comment is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: comment text, in the order it appears in a comment. `{brand}`
# is replaced by the caller's product name.
# ---------------------------------------------------------------------------
COMMENT_HEADER = "## {brand} Code Review"
BANNER_APPROVE = "✅ **All checks passed.** {brand} found no critical security or performance vulnerabilities."
BANNER_COMMENT = (
    "⚠️ **Action Recommended.** {brand} identified several warnings and style issues, "
    "but no critical vulnerabilities blocking merge."
)
BANNER_CHANGES = (
    "❌ **Changes Requested.** {brand} identified **CRITICAL** issues that must be "
    "addressed before merging."
)
CRITICAL_HEADING = "### 🚨 Critical Findings ("
NO_CRITICAL = "*No critical issues found.*\n"
WARNING_HEADING = "### ⚠️ Warnings ("
WARNING_OPEN = "<details>\n<summary>Click to view warnings</summary>\n\n"
NO_WARNING = "*No warnings found.*\n"
INFO_HEADING = "### 💡 Info & Style Suggestions ("
INFO_OPEN = "<details>\n<summary>Click to view minor suggestions</summary>\n\n"
NO_INFO = "*No style issues found.*\n"
DETAILS_CLOSE = "</details>\n"
FOOTER = "*{brand} analyzed "

# FIXED VALUES: one finding (critical heading; warning/info collapsible block;
# fallback bullet for other severities), pieces in order.
CRITICAL_ITEM_PREFIX = "#### 🚨 ["
CRITICAL_ITEM_RECOMMENDATION = "\n\n**Recommendation:**\n> "
COLLAPSIBLE_OPEN = "<details>\n<summary><b>["
COLLAPSIBLE_TITLE_CLOSE = "]</b> "
COLLAPSIBLE_SUMMARY_CLOSE = "</summary>\n\n"
COLLAPSIBLE_SUGGESTION_OPEN = "\n\n> _"
COLLAPSIBLE_CLOSE = "_\n</details>"
FALLBACK_OPEN = "- **"
FALLBACK_SEPARATOR = "**: "

DEFAULT_BRAND = "Revlens"

# Characters after which a title-cased word starts (besides whitespace).
_WORD_BREAK = r"([-\s({\[<])"
_MARK = "\u0001"


def title_case(s: Column) -> Column:
    """Template-style `title`: upper-case the first letter of every word and
    lower-case the rest, where words begin after whitespace or - ( { [ <.

    (`initcap` only breaks on spaces, so 'n-plus-one' would stay 'N-plus-one'.)
    """
    marked = F.regexp_replace(s, _WORD_BREAK, "$1" + _MARK)
    parts = F.split(marked, _MARK)
    cased = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30))))
    return F.array_join(cased, "")


def _line_suffix(line: Column, prefix: str, suffix: str = "") -> Column:
    return F.when(line.isNotNull() & (line != 0), F.concat(F.lit(prefix), line.cast("string"), F.lit(suffix))).otherwise(
        F.lit("")
    )


def finding_markdown(
    severity: Column, category: Column, file: Column, line: Column, message: Column, suggestion: Column
) -> Column:
    """One finding as Markdown, by its lower-cased severity.

    critical: heading + message + recommendation quote; warning / info: a
    collapsible block; any other severity: a one-line bullet with the raw
    category.
    """
    sev = F.lower(F.coalesce(severity, F.lit("info")))
    title = title_case(category)
    critical = F.concat(
        F.lit(CRITICAL_ITEM_PREFIX), title, F.lit("] "), file, _line_suffix(line, " (Line ", ")"),
        F.lit("\n"), message, F.lit(CRITICAL_ITEM_RECOMMENDATION), suggestion,
    )
    collapsible = F.concat(
        F.lit(COLLAPSIBLE_OPEN), title, F.lit(COLLAPSIBLE_TITLE_CLOSE), file, _line_suffix(line, ": Line "),
        F.lit(COLLAPSIBLE_SUMMARY_CLOSE), message, F.lit(COLLAPSIBLE_SUGGESTION_OPEN), suggestion, F.lit(COLLAPSIBLE_CLOSE),
    )
    fallback = F.concat(F.lit(FALLBACK_OPEN), category, F.lit(FALLBACK_SEPARATOR), message)
    return F.when(sev == "critical", critical).when(sev.isin("warning", "info"), collapsible).otherwise(fallback)


def comment_frame(
    verdict: Column, n_critical: Column, n_warning: Column, n_info: Column, files: Column, additions: Column, execution_ms: Column,
    brand: str = DEFAULT_BRAND,
) -> list[Column]:
    """The four fixed texts of a comment: before the critical findings, between them and the
    warnings, between those and the info findings, and after all."""
    banner = (
        F.when(verdict == "approve", F.lit(BANNER_APPROVE.format(brand=brand)))
        .when(verdict == "comment", F.lit(BANNER_COMMENT.format(brand=brand)))
        .otherwise(F.lit(BANNER_CHANGES.format(brand=brand)))
    )

    def heading(text: str, count: Column, opener: str, none: str) -> Column:
        return F.concat(F.lit(text), count.cast("string"), F.lit(")\n"), F.when(count > 0, F.lit(opener)).otherwise(F.lit(none)))

    def close(count: Column) -> Column:
        return F.when(count > 0, F.lit(DETAILS_CLOSE)).otherwise(F.lit(""))

    return [
        F.concat(
            F.lit(COMMENT_HEADER.format(brand=brand) + "\n\n"), banner, F.lit("\n\n---\n\n"),
            heading(CRITICAL_HEADING, n_critical, "", NO_CRITICAL),
        ),
        F.concat(F.lit("\n---\n\n"), heading(WARNING_HEADING, n_warning, WARNING_OPEN, NO_WARNING)),
        F.concat(close(n_warning), F.lit("\n---\n\n"), heading(INFO_HEADING, n_info, INFO_OPEN, NO_INFO)),
        F.concat(
            close(n_info), F.lit("\n---\n" + FOOTER.format(brand=brand)), files.cast("string"), F.lit(" files ("),
            additions.cast("string"), F.lit(" additions) in "), execution_ms.cast("string"), F.lit("ms.*"),
        ),
    ]


def review_comment_parts(
    verdict: Column,
    n_critical: Column,
    critical_items: Column,
    n_warning: Column,
    warning_items: Column,
    n_info: Column,
    info_items: Column,
    files: Column,
    additions: Column,
    execution_ms: Column,
    brand: str = DEFAULT_BRAND,
) -> Column:
    """The whole review comment. `*_items` are the concatenated finding
    partials of a bucket, each followed by a newline."""
    head, to_warnings, to_info, foot = comment_frame(verdict, n_critical, n_warning, n_info, files, additions, execution_ms, brand)

    def items(count: Column, text: Column) -> Column:
        return F.when(count > 0, text).otherwise(F.lit(""))

    return F.concat(
        head, items(n_critical, critical_items), to_warnings, items(n_warning, warning_items), to_info, items(n_info, info_items), foot
    )
