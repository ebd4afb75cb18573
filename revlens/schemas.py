"""Declared record types (no inference anywhere).

Tables stay normalised (files, chunks, findings are rows keyed by review_id);
the nested event shapes below are for sinks that must emit the nested message
(`nest_parsed_event`), and only for reviews of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


AGENT_META = T.StructType([
    _f("agent", S, False), _f("model", S), _f("tokens_in", L), _f("tokens_out", L), _f("latency_ms", L),
    _f("tools_called", T.ArrayType(S)),
])

WEBHOOK_EVENT = T.StructType([
    _f("action", S, False), _f("repo_full_name", S, False), _f("repo_clone_url", S, False), _f("pr_number", L, False),
    _f("pr_title", S, False), _f("pr_url", S, False), _f("pr_diff_url", S, False), _f("head_sha", S, False),
    _f("base_ref", S, False), _f("head_ref", S, False), _f("sender", S, False), _f("installation_id", L),
])

FILE_CHANGE = T.StructType([
    _f("path", S, False), _f("language", S, False), _f("status", S, False), _f("additions", L), _f("deletions", L),
    _f("patch", S), _f("source_path", S),
])

DIFF_CHUNK = T.StructType([
    _f("chunk_index", L, False), _f("total_chunks", L, False), _f("files", T.ArrayType(FILE_CHANGE)), _f("total_lines", L),
])

PR_STATS = T.StructType([
    _f("total_files", L), _f("total_additions", L), _f("total_deletions", L), _f("languages", T.ArrayType(S)),
    _f("has_generated_files", B), _f("generated_files_filtered", L),
])

FINDING = T.StructType([
    _f("severity", S, False), _f("category", S, False), _f("file", S, False), _f("line", L), _f("message", S, False),
    _f("suggestion", S), _f("agent", S),
])

REVIEW_EVENT = T.StructType([
    _f("event_type", S, False), _f("review_id", S, False), _f("timestamp", TS), _f("trace_id", S),
    _f("agent_meta", AGENT_META), _f("repo_full_name", S), _f("pr_number", L), _f("pr_url", S), _f("head_sha", S),
    _f("findings", T.ArrayType(FINDING)), _f("files_analyzed", L), _f("chunks_analyzed", L),
])

MODEL_RESPONSE = T.StructType([
    _f("text", S), _f("tokens_in", L), _f("tokens_out", L), _f("latency_ms", L), _f("model_id", S),
])

STORE_ITEM = T.StructType([_f("pk", S, False), _f("sk", S, False), _f("attrs", T.MapType(S, S))])

QUEUE_MESSAGE = T.StructType([_f("message_id", S, False), _f("receipt_handle", S), _f("body", S)])


def nest_parsed_event(assigned: DataFrame, stats: DataFrame) -> DataFrame:
    """The nested parsed-PR message (files[] and chunks[] per review) for a
    sink that needs it. Gathers a review into one row, so use it only where
    reviews are bounded (the hosting service caps files per pull request)."""
    file_struct = F.struct(*[F.col(c) for c in FILE_CHANGE.fieldNames()])
    chunks = assigned.groupBy("review_id", "chunk_index").agg(
        F.max("total_chunks").alias("total_chunks"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", file_struct.alias("f")))), lambda x: x["f"]).alias("files"),
        F.sum(F.col("additions") + F.col("deletions")).alias("total_lines"),
    )
    per_review = chunks.groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "total_chunks", "files", "total_lines"))).alias("chunks"),
    )
    return stats.join(per_review, "review_id", "left").select(
        F.lit("pr.parsed").alias("event_type"),
        "review_id",
        F.struct(*[F.col(c) for c in PR_STATS.fieldNames()]).alias("stats"),
        F.coalesce(F.col("chunks"), F.array().cast(T.ArrayType(DIFF_CHUNK))).alias("chunks"),
    )
