"""Path-derived columns: language, generated-file flag, status mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import rules

# Extension as os.path.splitext computes it on the base name: the last dot that
# follows at least one non-dot character of the final path component.
EXTENSION_REGEX = r"[^/.][^/]*(\.[^/.]*)$"


def _map_literal(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def file_extension(path: Column) -> Column:
    """Lower-cased extension including the dot, '' when there is none."""
    return F.regexp_extract(F.lower(path), EXTENSION_REGEX, 1)


def detect_language(path: Column) -> Column:
    """Language of a file path.

    `dockerfile` when the lower-cased path ends or starts with "dockerfile",
    `makefile` when it ends with "makefile", else the extension map, else
    "unknown".
    """
    lower = F.lower(path)
    by_ext = F.try_element_at(_map_literal(rules.LANGUAGE_BY_EXTENSION), file_extension(path))
    return (
        F.when(lower.endswith("dockerfile") | lower.startswith("dockerfile"), F.lit("dockerfile"))
        .when(lower.endswith("makefile"), F.lit("makefile"))
        .otherwise(F.coalesce(by_ext, F.lit("unknown")))
    )


def _literal_regex(text: str) -> str:
    """Regex matching `text` literally (Java and RE2 syntax)."""
    return "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in text)


# One alternation of the literal markers: a single pass over the path instead
# of 26 `contains` calls (each of which would repeat the path expression in
# generated code once filters are pushed below projections).
GENERATED_REGEX = "|".join(_literal_regex(m) for m in rules.GENERATED_FILE_MARKERS)


def is_generated_file(path: Column) -> Column:
    """True when any marker occurs (as written, case-sensitively) in the
    lower-cased path."""
    return F.lower(path).rlike(GENERATED_REGEX)


def map_file_status(status: Column) -> Column:
    """added / modified / removed->deleted / renamed; anything else -> modified."""
    return F.coalesce(
        F.try_element_at(_map_literal(rules.FILE_STATUS_MAP), status),
        F.lit(rules.DEFAULT_FILE_STATUS),
    )
