"""String / JSON helpers for model responses and findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import rules

# ASCII whitespace at either end (Java `\s`, identical in RE2).
_EDGE_SPACE = r"^\s+|\s+$"


def py_strip(s: Column) -> Column:
    """Strip leading and trailing whitespace (ASCII whitespace set)."""
    return F.regexp_replace(s, _EDGE_SPACE, "")


def code_fence_extract(text: Column) -> Column:
    """JSON text out of a model reply that may wrap it in a Markdown fence.

    Strip; if a "```json" fence occurs take what follows the first one up to the
    next "```" (or the end); else if "```" occurs take what lies between the
    first two; strip again.
    """
    s = py_strip(text)
    # The segment runs to the next "```json" (split semantics), then is cut at
    # its first "```".
    segment = F.regexp_extract(s, r"(?s)```json(.*?)(?:```json|\z)", 1)
    after_json = F.regexp_extract(segment, r"(?s)^(.*?)(?:```|\z)", 1)
    between = F.regexp_extract(s, r"(?s)```(.*?)(?:```|\z)", 1)
    picked = F.when(s.contains("```json"), after_json).when(s.contains("```"), between).otherwise(s)
    return py_strip(picked)


def severity_normalise(sev: Column) -> Column:
    """Lower-case; anything outside critical/warning/info (or NULL) -> info."""
    low = F.lower(sev)
    return F.when(low.isin(*rules.SEVERITIES), low).otherwise(F.lit("info"))


def severity_rank(sev: Column, case_sensitive: bool = True) -> Column:
    """0 critical, 1 warning, 2 info, 3 anything else."""
    key = sev if case_sensitive else F.lower(sev)
    rank_map = F.create_map(*[F.lit(x) for kv in rules.SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(rank_map, key), F.lit(rules.OTHER_SEVERITY_RANK))


def category_label(category: Column) -> Column:
    """Display label of a category; the raw category when unlisted."""
    labels = F.create_map(*[F.lit(x) for kv in rules.CATEGORY_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, category), category)


def finding_location(file: Column, line: Column) -> Column:
    """`file:line`, or just `file` when line <= 0 (or missing)."""
    return F.when(line > 0, F.concat(file, F.lit(":"), line.cast("string"))).otherwise(file)


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, else NULL.

    The JSON reader stops after the first value. Inside an array and as a member of
    an object, text after the value makes the whole malformed (what could continue
    one of them breaks the other, and without a `]` nothing can end the array); both are
    only scanned for that, the value itself is parsed once.
    """
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    member = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(one & (~text.contains("]") | member), F.try_parse_json(text))


def json_fields(v: Column, names: list[str]) -> Column:
    """The members `names` of a VARIANT object as a struct of VARIANTs, taken apart in one
    pass; NULL where `v` is no object, a NULL field where a member is absent."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def json_type(v: Column, path: str = "$") -> Column:
    """Type name at `path` ('STRING', 'BIGINT', 'VOID' for JSON null, 'OBJECT<...>',
    ...), NULL where there is nothing."""
    return F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant"))


def json_int(v: Column, path: str) -> Column:
    """Integer at `path`: an integer, a number without a fraction, a string of digits
    or a boolean, within 64 bits; else NULL."""
    t = json_type(v, path)
    num = F.try_variant_get(v, path, "double")
    s = F.try_variant_get(v, path, "string")
    return (
        F.when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, path, "bigint"))
        .when((t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")) & (num == F.floor(num)), num.try_cast("bigint"))
        .when((t == "STRING") & s.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(s).try_cast("bigint"))
        .when(t == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("bigint"))
    )
