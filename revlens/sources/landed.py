"""Landed inputs: webhook envelopes, queue messages, hosting-API file lists and
PR metadata, and typed decoding of inter-stage events.

Each reader has a batch form over a DataFrame of raw strings and a streaming
form (`read_*`) over a landing directory with a declared schema (no inference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.text import json_fields, json_int, json_type, strict_json

ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("isBase64Encoded", T.BooleanType()),
    ]
)

FILE_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("additions", T.LongType()),
        T.StructField("deletions", T.LongType()),
        T.StructField("patch", T.StringType()),
        T.StructField("previous_filename", T.StringType()),
    ]
)

META_SCHEMA = (
    "title string, body string, html_url string, diff_url string, head struct<sha:string, ref:string>, "
    "base struct<ref:string>, user struct<login:string>, labels array<struct<name:string>>, "
    "created_at string, updated_at string"
)

# Declared event schema of a flat webhook event: (name, type, default or None
# when required).
WEBHOOK_EVENT_FIELDS: list[tuple[str, str, object]] = [
    ("action", "string", None),
    ("repo_full_name", "string", None),
    ("repo_clone_url", "string", None),
    ("pr_number", "bigint", None),
    ("pr_title", "string", None),
    ("pr_url", "string", None),
    ("pr_diff_url", "string", None),
    ("head_sha", "string", None),
    ("base_ref", "string", None),
    ("head_ref", "string", None),
    ("sender", "string", None),
    ("installation_id", "bigint", 0),
]


def read_envelopes(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming read of landed HTTP envelopes (JSON lines)."""
    return spark.readStream.schema(ENVELOPE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(path)


def kafka_messages(raw: DataFrame) -> DataFrame:
    """Kafka source rows -> (message_id, body, attributes, ts). Attributes are
    the record headers (values as UTF-8 text)."""
    headers = F.map_from_entries(F.transform(F.col("headers"), lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return raw.select(
        F.concat_ws("-", F.col("topic"), F.col("partition").cast("string"), F.col("offset").cast("string")).alias("message_id"),
        F.col("value").cast("string").alias("body"),
        F.coalesce(headers, F.create_map().cast("map<string,string>")).alias("attributes"),
        F.col("timestamp").alias("ts"),
    )


def read_topic(spark: SparkSession, bootstrap_servers: str, topic: str, max_offsets_per_trigger: int = 100_000) -> DataFrame:
    """A topic as a message stream for production; needs the Spark Kafka
    connector on the classpath."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .load()
    )
    return kafka_messages(raw)


def webhook_envelopes(envelopes: DataFrame) -> DataFrame:
    """Header names lower-cased; body decoded from base64 when flagged.

    Adds `hdrs` (lower-cased map), `body_text` and `body_bytes` (the raw
    bytes the signature is computed over). A body that is flagged as base64 and
    is not gives NULL bytes, bytes that are not UTF-8 a NULL text: admission
    answers these (`bad_body`), other rows are not touched by them.
    """
    hdrs = F.transform_keys(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    b64 = F.coalesce(F.col("isBase64Encoded"), F.lit(False))
    body = F.coalesce(F.col("body"), F.lit(""))
    raw = F.when(b64, F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(body, "UTF-8"))
    return envelopes.withColumn("hdrs", hdrs).withColumn("body_bytes", raw).withColumn(
        "body_text", F.try_validate_utf8(F.col("body_bytes").cast("string"))
    )


def header(name: str) -> Column:
    return F.try_element_at(F.col("hdrs"), F.lit(name))


def queue_messages(messages: DataFrame, body: str = "body") -> DataFrame:
    """Parse message bodies; a malformed body is kept as {"raw": body}, not
    dropped. Adds `payload` (VARIANT) and `is_raw`."""
    parsed = strict_json(F.col(body))
    raw = F.parse_json(F.to_json(F.struct(F.col(body).alias("raw"))))
    return messages.withColumn("is_raw", parsed.isNull()).withColumn("payload", F.coalesce(parsed, raw))


def unwrap_envelope(body: Column) -> Column:
    """Topic deliveries wrap the event as {"Message": "<json>"}: take
    `Message` when present (string -> its text, object -> its JSON), else the
    body itself. Returns the event's JSON text."""
    return F.coalesce(F.get_json_object(body, "$.Message"), body)


def route_payload(body: Column, enveloped: Column) -> Column:
    """Per-source routing: raw sources deliver the event itself, enveloped
    (topic) sources wrap it."""
    return F.when(enveloped, unwrap_envelope(body)).otherwise(body)


def pr_files(file_json: DataFrame) -> DataFrame:
    """Hosting-API file objects -> file rows (patch '' when missing)."""
    f = F.from_json(F.col("file_json"), FILE_SCHEMA)
    return file_json.select("review_id", "ordinal", f.alias("f")).select(
        "review_id",
        "ordinal",
        "f.filename",
        "f.status",
        F.coalesce("f.additions", F.lit(0)).alias("additions"),
        F.coalesce("f.deletions", F.lit(0)).alias("deletions"),
        F.coalesce("f.patch", F.lit("")).alias("patch"),
        "f.previous_filename",
    )


def pr_metadata(meta_json: DataFrame) -> DataFrame:
    """Flattened PR metadata: body null -> '', labels -> names."""
    m = F.from_json(F.col("meta_json"), META_SCHEMA)
    return meta_json.select("pr_number", m.alias("m")).select(
        "pr_number",
        F.col("m.title").alias("title"),
        F.coalesce("m.body", F.lit("")).alias("body"),
        F.col("m.html_url").alias("url"),
        F.col("m.diff_url").alias("diff_url"),
        F.col("m.head.sha").alias("head_sha"),
        F.col("m.base.ref").alias("base_ref"),
        F.col("m.head.ref").alias("head_ref"),
        F.col("m.user.login").alias("user"),
        F.transform(F.coalesce("m.labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]).alias("labels"),
        F.col("m.created_at").alias("created_at"),
        F.col("m.updated_at").alias("updated_at"),
    )


# Nested event models, as WEBHOOK_EVENT_FIELDS: (name, type, default or None when
# required). A type is a name, ("enum", values), ("object", fields), ("list", fields or
# a type name) or ("nullable", type); OPTIONAL marks lists and objects with defaults.
OPTIONAL = ()
_FILE = [
    ("path", "string", None), ("language", "string", None), ("status", ("enum", ("added", "modified", "deleted", "renamed")), None),
    ("additions", "bigint", 0), ("deletions", "bigint", 0), ("patch", "string", ""), ("source_path", ("nullable", "string"), ""),
]
_CHUNK = [("chunk_index", "bigint", None), ("total_chunks", "bigint", None), ("files", ("list", _FILE), None), ("total_lines", "bigint", 0)]
_STATS = [
    ("total_files", "bigint", 0), ("total_additions", "bigint", 0), ("total_deletions", "bigint", 0), ("languages", ("list", "string"), OPTIONAL),
    ("has_generated_files", "boolean", False), ("generated_files_filtered", "bigint", 0),
]
_FINDING = [
    ("severity", ("enum", ("critical", "warning", "info")), None), ("category", "string", None), ("file", "string", None),
    ("line", "bigint", 0), ("message", "string", None), ("suggestion", "string", ""), ("agent", "string", ""),
]
_META = [
    ("agent", "string", None), ("model", "string", "none"), ("tokens_in", "bigint", 0), ("tokens_out", "bigint", 0),
    ("latency_ms", "bigint", 0), ("tools_called", ("list", "string"), OPTIONAL),
]
_BASE = [("review_id", "string", None), ("trace_id", "string", ""), ("agent_meta", ("object", _META), OPTIONAL)]
PARSED_EVENT_FIELDS = [
    *_BASE, ("event_type", "string", "pr.parsed"),
    *[(k, t, None) for k, t in (("repo_full_name", "string"), ("pr_number", "bigint"), ("pr_title", "string"), ("pr_url", "string"),
                                ("head_sha", "string"), ("base_ref", "string"), ("head_ref", "string"), ("sender", "string"))],
    ("installation_id", "bigint", 0), ("files", ("list", _FILE), OPTIONAL), ("chunks", ("list", _CHUNK), OPTIONAL),
    ("stats", ("object", _STATS), OPTIONAL),
]
REVIEW_EVENT_FIELDS = [
    *_BASE, ("event_type", "string", "review.security"),
    *[(k, t, None) for k, t in (("repo_full_name", "string"), ("pr_number", "bigint"), ("pr_url", "string"), ("head_sha", "string"))],
    ("findings", ("list", _FINDING), OPTIONAL), ("files_analyzed", "bigint", 0), ("chunks_analyzed", "bigint", 0),
]
EVENT_MODELS = {"webhook": WEBHOOK_EVENT_FIELDS, "parsed": PARSED_EVENT_FIELDS, "review": REVIEW_EVENT_FIELDS}


def _all(checks: list[Column]) -> Column:
    out = F.lit(True)
    for c in checks:
        out = out & c
    return out


def _is_type(v: Column, path: str, typ) -> Column:
    """Is the value at `path` of VARIANT `v` of the type (see EVENT_MODELS)?"""
    t = json_type(v, path)
    if isinstance(typ, str):
        if typ == "bigint":
            return json_int(v, path).isNotNull()
        return F.coalesce(t == {"string": "STRING", "boolean": "BOOLEAN"}[typ], F.lit(False))
    kind, of = typ
    if kind == "enum":
        return F.coalesce((t == "STRING") & F.try_variant_get(v, path, "string").isin(*of), F.lit(False))
    if kind == "nullable":
        return F.coalesce(t == "VOID", F.lit(False)) | _is_type(v, path, of)
    if kind == "object":
        inner = [_field_ok(v, f"{path}.{name}", ft, default) for name, ft, default in of]
        return F.coalesce(t.startswith("OBJECT"), F.lit(False)) & _all(inner)
    if isinstance(of, str):
        ok = lambda e: _is_type(e, "$", of)
    else:
        def ok(e):
            fields = _all([_field_ok(e, f"$.{name}", ft, default) for name, ft, default in of])
            return F.coalesce(json_type(e).startswith("OBJECT"), F.lit(False)) & fields
    every = F.forall(F.try_variant_get(v, path, "array<variant>"), ok)
    return F.coalesce(t.startswith("ARRAY"), F.lit(False)) & F.coalesce(every, F.lit(False))


def _field_ok(v: Column, path: str, typ, default) -> Column:
    ok = _is_type(v, path, typ)
    return ok if default is None else json_type(v, path).isNull() | ok


def _value(v: Column, path: str, typ, default) -> Column:
    """Typed value, its default where there is none; lists and objects as JSON text."""
    present = json_type(v, path).isNotNull()
    if typ == "bigint":
        value, kind = json_int(v, path), "bigint"
    elif typ == "boolean":
        value, kind = F.try_variant_get(v, path, "boolean"), "boolean"
    elif typ == "string" or typ[0] in ("enum", "nullable") and typ[1] == "string" or typ[0] == "enum":
        value, kind = F.try_variant_get(v, path, "string"), "string"
    else:
        value, kind = F.to_json(F.try_variant_get(v, path, "variant")), "string"
    if default is None or default == OPTIONAL:
        return value
    return F.when(present, value).otherwise(F.lit(default)).cast(kind)


def typed_events(raw: DataFrame, text: str = "text", fields=WEBHOOK_EVENT_FIELDS) -> DataFrame:
    """Decode JSON events against a declared model (EVENT_MODELS) with defaults.

    Adds the typed fields, `valid` and `violations` (names of missing or mistyped
    fields; one bad element makes its list bad). Nothing is silently dropped:
    `quarantined` gives the rows to keep aside.
    """
    # the object is taken apart once; each field's tests and value look at its own member
    out = raw.withColumn("__v", json_fields(strict_json(F.col(text)), [name for name, _, _ in fields]))
    is_obj = F.col("__v").isNotNull()
    cols = [_value(F.col("__v")[name], "$", typ, default).alias(name) for name, typ, default in fields]
    problems = [F.when(~_field_ok(F.col("__v")[name], "$", typ, default), F.lit(name)) for name, typ, default in fields]
    violations = F.filter(F.array(*problems), lambda x: x.isNotNull())
    return out.select(
        "*", *cols, F.when(is_obj, violations).otherwise(F.array(F.lit("<not an object>"))).alias("violations")
    ).withColumn("valid", F.size("violations") == 0).drop("__v")


def quarantined(typed: DataFrame, text: str = "text") -> DataFrame:
    """(text, violations) of the events that do not decode, for a quarantine table."""
    return typed.where(~F.col("valid")).select(text, F.array_join("violations", ",").alias("violations"))
