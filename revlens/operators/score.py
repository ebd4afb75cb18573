"""Model scoring of diff chunks (the one place user Python runs per row).

* `chunk_prompts` builds each chunk's prompt with native string functions.
* `score_chunks` runs a user-supplied scorer over every (chunk, reviewer) and
  `score` over rows of (prompt, system prompt, model), both with `mapInPandas`:
  Arrow batches, one client per task, retries with exponential back-off on
  throttling, and per-row error capture so a failed chunk only loses its own
  findings. `calls_per_second` bounds the call rate, whatever the partitions.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import rules

SCORED_SCHEMA = (
    "text string, tokens_in bigint, tokens_out bigint, latency_ms bigint, attempts int, waited_s double, error string"
)


class ModelError(Exception):
    """A failed model call; `code` decides whether it is retried."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


def reviewer_rows() -> list[tuple]:
    """The configured reviewers, as rows of the reviewer columns."""
    return [(a, c, e, rules.REVIEWER_PROMPTS[a], rules.ON_INVALID[a], rules.REVIEWER_MODELS[a]) for a, c, e in rules.REVIEWERS]


_REVIEWER_FIELDS = ["agent", "default_category", "event_type", "system_prompt", "on_invalid", "model_id"]


def reviewer_structs(reviewers: list[tuple] | None = None):
    """Reviewer rows (the configured ones by default) as a literal array of structs."""
    rows = reviewer_rows() if reviewers is None else reviewers
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(_REVIEWER_FIELDS, row)]) for row in rows])


def reviewer_table(spark: SparkSession) -> DataFrame:
    """The four reviewers: name, default category, event type, system prompt,
    error rule and configured model. Fixed size (4 rows): safe to broadcast."""
    return spark.createDataFrame(
        reviewer_rows(),
        "agent string, default_category string, event_type string, system_prompt string, on_invalid string, model_id string",
    )


def route_table(spark: SparkSession, routes: dict[str, str] | None = None) -> DataFrame:
    routes = rules.MODEL_ROUTES if routes is None else routes
    return spark.createDataFrame(list(routes.items()), "route_key string, routed_model string")


def route_models(df: DataFrame, routes: DataFrame, default: str = rules.DEFAULT_MODEL) -> DataFrame:
    """Add `model_id` = routing table entry for `agent`, else `default`.
    The routing table is configuration (a handful of rows): broadcast."""
    joined = df.join(F.broadcast(routes), F.col("agent") == F.col("route_key"), "left")
    return joined.withColumn("model_id", F.coalesce(F.col("routed_model"), F.lit(default))).drop(
        "route_key", "routed_model"
    )


def chunk_prompts(assigned: DataFrame) -> DataFrame:
    """One prompt per chunk: a heading line, then per file a `### File:` line
    and the fenced diff, pieces joined by newlines.

    The files of a chunk are bounded by the chunk's line budget, so gathering
    them is a bounded group.
    """
    block = F.concat(
        F.lit("### File: "), F.col("path"), F.lit(" (language: "), F.col("language"), F.lit(")\n```diff\n"),
        F.col("patch"), F.lit("\n```\n"),
    )
    per_chunk = assigned.groupBy("review_id", "chunk_index").agg(
        F.max("total_chunks").alias("total_chunks"),
        F.array_sort(F.collect_list(F.struct(F.col("ordinal"), block.alias("block")))).alias("__blocks"),
        F.count(F.lit(1)).alias("n_files"),
    )
    head = F.concat(
        F.lit("Review this code diff (chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit("/"),
        F.col("total_chunks").cast("string"), F.lit("):\n"),
    )
    return per_chunk.select(
        "review_id",
        "chunk_index",
        "total_chunks",
        "n_files",
        F.concat(head, F.lit("\n"), F.array_join(F.transform("__blocks", lambda b: b["block"]), "\n")).alias("prompt"),
    )


def fan_out(chunks: DataFrame, reviewers: list[tuple] | None = None) -> DataFrame:
    """Every chunk goes to every reviewer: each row is expanded by a generator
    over the literal array of reviewers (no join; the factor is fixed by
    configuration). `reviewers` are rows as of `reviewer_rows()`."""
    return chunks.select("*", F.explode(reviewer_structs(reviewers)).alias("__r")).select(
        *[c for c in chunks.columns], *[F.col(f"__r.{k}").alias(k) for k in _REVIEWER_FIELDS]
    )


def _call_with_retry(scorer, prompt, system_prompt, model_id, sleep, max_attempts, base, params=None):
    """(reply, attempts, seconds waited, error code). Throttling-type errors
    wait base * 2**attempt and retry (the wait also follows the last failed
    attempt, as in the original client); other errors fail at once."""
    waited = 0.0
    last_code = None
    for attempt in range(max_attempts):
        try:
            return scorer(prompt, system_prompt, model_id, **(params or {})), attempt + 1, waited, None
        except ModelError as e:
            if e.code not in rules.RETRYABLE_ERRORS:
                return None, attempt + 1, waited, e.code
            last_code = e.code
            wait = base * (2**attempt)
            sleep(wait)
            waited += wait
        except Exception as e:  # any other failure: no retry
            return None, attempt + 1, waited, type(e).__name__
    return None, max_attempts, waited, last_code


def request_key(*parts) -> str:
    """Idempotency key of a call: the same row gives the same key when its task is
    run again, so a service that knows it can return its first reply."""
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


class _Pace:
    """Spaces a task's calls: each of `callers` tasks has its share of the rate, so all of
    them together stay below it however many run side by side."""

    def __init__(self, calls_per_second: float | None, callers: int, sleep):
        self.gap = callers / calls_per_second if calls_per_second else 0.0
        self.sleep, self.next = sleep, 0.0

    def wait(self) -> None:
        if self.gap:
            now = time.monotonic()
            if now < self.next:
                self.sleep(self.next - now)
            self.next = max(now, self.next) + self.gap


_REPLY_NAMES = [x.split()[0] for x in SCORED_SCHEMA.split(", ")]


def _reply(scorer, pace, prompt, system_prompt, model_id, sleep, max_attempts, base, params) -> tuple:
    pace.wait()
    out, attempts, waited, error = _call_with_retry(scorer, prompt, system_prompt, model_id, sleep, max_attempts, base, params)
    out = out or {}
    counts = [int(out.get(k, 0) or 0) for k in ("tokens_in", "tokens_out", "latency_ms")]
    return (out.get("text"), *counts, attempts, float(waited), error)


def _ddl(fields) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SCORED_SCHEMA])


def _call_params(temperature: float, max_tokens: int) -> dict:
    return {"temperature": temperature, "max_tokens": max_tokens}


def score(
    rows: DataFrame,
    scorer_factory: Callable[[], Callable[..., dict]],
    sleep: Callable[[float], None] = time.sleep,
    max_attempts: int = rules.MAX_MODEL_ATTEMPTS,
    backoff_base: float = rules.BACKOFF_BASE_SECONDS,
    calls_per_second: float | None = None,
    callers: int | None = None,
    temperature: float = rules.MODEL_TEMPERATURE,
    max_tokens: int = rules.MODEL_MAX_TOKENS,
) -> DataFrame:
    """Score `rows` (needs prompt, system_prompt, model_id): their other columns
    and the reply columns of SCORED_SCHEMA. Prompts do not come back.

    `scorer_factory()` is called once per task (client reuse); the scorer is
    called with (prompt, system prompt, model) and the keywords temperature,
    max_tokens and request_key, returns a dict with text / tokens_in /
    tokens_out / latency_ms and raises `ModelError(code)` on failure.
    `calls_per_second` bounds the rate of all tasks of the job together: the rows
    are dealt to `callers` tasks (by default as many as the session runs side by
    side), each of which has its share, so the bound holds with any number of
    executors; fewer slots than callers leave rate unused. Calls of one task run one
    after another. Without a rate the rows stay where they are.
    """
    back = [f for f in rows.schema.fields if f.name not in ("prompt", "system_prompt")]
    names = [f.name for f in back]
    rows, callers = _dealt(rows, calls_per_second, callers)
    params = _call_params(temperature, max_tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, pace = scorer_factory(), _Pace(calls_per_second, callers, sleep)
        for pdf in batches:
            replies = [
                _reply(scorer, pace, p, s, m, sleep, max_attempts, backoff_base, {**params, "request_key": request_key(p, s, m)})
                for p, s, m in zip(pdf["prompt"], pdf["system_prompt"], pdf["model_id"])
            ]
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame(replies, columns=_REPLY_NAMES)], axis=1)

    return rows.mapInPandas(run, _ddl(back))


def score_chunks(
    prompts: DataFrame,
    scorer_factory: Callable[[], Callable[..., dict]],
    reviewers: list[tuple] | None = None,
    sleep: Callable[[float], None] = time.sleep,
    max_attempts: int = rules.MAX_MODEL_ATTEMPTS,
    backoff_base: float = rules.BACKOFF_BASE_SECONDS,
    calls_per_second: float | None = None,
    callers: int | None = None,
    temperature: float = rules.MODEL_TEMPERATURE,
    max_tokens: int = rules.MODEL_MAX_TOKENS,
) -> DataFrame:
    """Every reviewer's reply to every chunk of `chunk_prompts`: keys, reviewer
    columns and reply columns. A prompt crosses to Python once; the reviewers
    take turns with it inside the task. `reviewers` are rows as of
    `reviewer_rows()`, the configured four by default. `calls_per_second` and
    `callers` as in `score`."""
    rows = reviewer_rows() if reviewers is None else reviewers
    back = [f for f in prompts.schema.fields if f.name != "prompt"]
    names = [f.name for f in back]
    prompts, callers = _dealt(prompts, calls_per_second, callers, "review_id", "chunk_index")
    params, at = _call_params(temperature, max_tokens), {k: i for i, k in enumerate(_REVIEWER_FIELDS)}
    shown = [k for k in _REVIEWER_FIELDS if k != "system_prompt"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in back), *(f"{k} string" for k in shown), SCORED_SCHEMA])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, pace = scorer_factory(), _Pace(calls_per_second, callers, sleep)
        for pdf in batches:
            out = []
            for row, prompt in zip(pdf[names].itertuples(index=False, name=None), pdf["prompt"]):
                keys = dict(zip(names, row))
                for r in rows:
                    key = request_key(keys["review_id"], keys["chunk_index"], r[at["agent"]])
                    reply = _reply(scorer, pace, prompt, r[at["system_prompt"]], r[at["model_id"]], sleep, max_attempts,
                                   backoff_base, {**params, "request_key": key})
                    out.append((*row, *[r[at[k]] for k in shown], *reply))
            yield pd.DataFrame(out, columns=[*names, *shown, *_REPLY_NAMES])

    return prompts.mapInPandas(run, ddl)


def _dealt(rows: DataFrame, calls_per_second: float | None, callers: int | None, *keys: str) -> tuple[DataFrame, int]:
    """Rows in exactly `callers` partitions if there is a rate (a stated number is not
    coalesced), and that number."""
    if not calls_per_second:
        return rows, 1
    callers = callers or _slots(rows.sparkSession)
    return rows.repartition(callers, *keys), callers


def _slots(spark: SparkSession) -> int:
    """Tasks that run side by side."""
    try:
        return max(1, spark.sparkContext.defaultParallelism)
    except Exception:  # Spark Connect has no driver-side context
        return 1
