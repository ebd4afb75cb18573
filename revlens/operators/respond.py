"""Model replies -> typed findings, with per-reviewer error rules.

Row-local throughout (no shuffle): each reply is decoded with the VARIANT
functions, its `findings` array is validated element by element with
higher-order functions, and only then exploded.

Outcomes per reply (chunk):
* `model_error`  the call failed: no findings, no tokens.
* `bad_json`     not JSON: no findings, tokens counted (all reviewers).
* `invalid`      JSON of the wrong shape (top level not an object, `findings`
                 null / not a list, or an element that cannot become a
                 finding). `drop_chunk` reviewers lose the whole chunk and its
                 tokens; `keep_prefix` reviewers keep the findings before the
                 first bad element and count tokens.
* `ok`

Text after the JSON value, be it prose or a second value, makes a reply
`bad_json` (`text.strict_json`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import rules
from revlens.functions.text import code_fence_extract, json_int, json_type, severity_normalise, strict_json

_FINDINGS_TYPE = (
    "array<struct<pos:int,severity:string,category:string,file:string,line:bigint,message:string,suggestion:string>>"
)


def _str_ok(e: Column, name: str) -> Column:
    t = json_type(e, f"$.{name}")
    return t.isNull() | (t == "STRING")


def _line_value(e: Column) -> Column:
    """Line as an integer, NULL when it cannot be one (missing -> 0)."""
    return F.when(json_type(e, "$.line").isNull(), F.lit(0).cast("bigint")).otherwise(json_int(e, "$.line"))


def _finding(e: Column, line: Column, default_category: Column, pos: Column) -> Column:
    return F.struct(
        pos.alias("pos"),
        severity_normalise(F.coalesce(F.variant_get(e, "$.severity", "string"), F.lit("INFO"))).alias("severity"),
        F.coalesce(F.variant_get(e, "$.category", "string"), default_category).alias("category"),
        F.coalesce(F.variant_get(e, "$.file", "string"), F.lit("unknown")).alias("file"),
        line.alias("line"),
        F.coalesce(F.variant_get(e, "$.message", "string"), F.lit("")).alias("message"),
        F.coalesce(F.variant_get(e, "$.suggestion", "string"), F.lit("")).alias("suggestion"),
    )


def _by_agent(mapping: dict[str, str], agent: Column, default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, agent), F.lit(default))


def decode_replies(replies: DataFrame) -> DataFrame:
    """Add `outcome`, `findings` (array of finding structs, in reply order)
    and the counted `tokens_in_counted` / `tokens_out_counted`.

    `replies` needs agent, text, tokens_in, tokens_out and optionally `error`
    (non-NULL when the model call failed). Each intermediate (fenced text,
    parsed VARIANT, element list with its line values) is its own column, so
    every reply is parsed once.
    """
    agent = F.col("agent")
    default_category = _by_agent({a: c for a, c, _ in rules.REVIEWERS}, agent, "other")
    drop_chunk = _by_agent(rules.ON_INVALID, agent, "keep_prefix") == "drop_chunk"
    has_error = F.col("error").isNotNull() if "error" in replies.columns else F.lit(False)

    staged = replies.withColumn("__js", code_fence_extract(F.col("text")))
    staged = staged.withColumn("__v", strict_json(F.col("__js")))
    v = F.col("__v")
    staged = staged.withColumn("__top", F.schema_of_variant(v)).withColumn("__ftype", json_type(v, "$.findings"))
    top, ftype = F.col("__top"), F.col("__ftype")
    bad_json = v.isNull()
    empty_iterable = (ftype == "OBJECT<>") | ((ftype == "STRING") & (F.variant_get(v, "$.findings", "string") == ""))
    shape_ok = top.startswith("OBJECT") & (ftype.isNull() | ftype.startswith("ARRAY") | empty_iterable)
    elem_list = F.when(ftype.startswith("ARRAY"), F.try_variant_get(v, "$.findings", "array<variant>")).otherwise(
        F.array().cast("array<variant>")
    )
    # one pass per element: its line value is computed once and reused
    staged = staged.withColumn("__shape_ok", shape_ok).withColumn("__bad_json", bad_json).withColumn(
        "__elems", F.transform(elem_list, lambda e: F.struct(e.alias("e"), _line_value(e).alias("line")))
    )
    oks = F.transform(
        F.col("__elems"),
        lambda x: F.coalesce(F.schema_of_variant(x["e"]).startswith("OBJECT"), F.lit(False))
        & _str_ok(x["e"], "severity") & _str_ok(x["e"], "category") & _str_ok(x["e"], "file")
        & _str_ok(x["e"], "message") & _str_ok(x["e"], "suggestion") & x["line"].isNotNull(),
    )
    staged = staged.withColumn("__first_bad", F.array_position(oks, False)).withColumn(
        "outcome",
        F.when(has_error, F.lit("model_error"))
        .when(F.col("__bad_json"), F.lit("bad_json"))
        .when(~F.col("__shape_ok") | (F.col("__first_bad") > 0), F.lit("invalid"))
        .otherwise(F.lit("ok")),
    )
    all_findings = F.transform(F.col("__elems"), lambda x, i: _finding(x["e"], x["line"], default_category, i))
    kept = (
        F.when(F.col("outcome") == "ok", all_findings)
        .when((F.col("outcome") == "invalid") & ~drop_chunk & F.col("__shape_ok"),
              F.slice(all_findings, 1, F.col("__first_bad") - 1))
    )
    lost = (F.col("outcome") == "model_error") | ((F.col("outcome") == "invalid") & drop_chunk)
    return (
        staged.withColumn("findings", F.coalesce(kept, F.array().cast(_FINDINGS_TYPE)))
        .withColumn("tokens_in_counted", F.when(lost, F.lit(0)).otherwise(F.col("tokens_in")).cast("bigint"))
        .withColumn("tokens_out_counted", F.when(lost, F.lit(0)).otherwise(F.col("tokens_out")).cast("bigint"))
        .drop("__js", "__v", "__top", "__ftype", "__shape_ok", "__bad_json", "__elems", "__first_bad")
    )


def reply_findings(decoded: DataFrame, keys: tuple[str, ...] = ("review_id", "agent", "chunk_index")) -> DataFrame:
    """One row per kept finding: keys + pos (0-based in the reply) + fields.

    `inline_outer` + a filter on its output instead of `explode`: for a plain
    explode Spark infers `size(findings) > 0` and pushes it below every
    projection, re-running the whole decode inside one uncompiled filter."""
    out = decoded.select(*keys, F.inline_outer("findings")).filter(F.col("pos").isNotNull())
    return out.select(*keys, F.col("pos").cast("bigint").alias("pos"), "severity", "category", "file", "line", "message", "suggestion")
