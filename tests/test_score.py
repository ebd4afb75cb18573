"""Scorer call semantics: retries, back-off, error capture, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators.score import ModelError, _call_with_retry, chunk_prompts, score, score_chunks
from revlens.plans.offline import OfflineScorer


def flaky(fail_codes):
    calls = {"n": 0}

    def scorer(prompt, system, model):
        i = calls["n"]
        calls["n"] += 1
        if i < len(fail_codes):
            raise ModelError(fail_codes[i])
        return {"text": "{}", "tokens_in": 1, "tokens_out": 1}

    return scorer


def test_retry_semantics():
    waits = []
    out, n, waited, err = _call_with_retry(flaky([]), "p", "s", "m", waits.append, 3, 1.0)
    assert (n, waited, err) == (1, 0.0, None) and out["text"] == "{}"
    out, n, waited, err = _call_with_retry(flaky(["ThrottlingException"]), "p", "s", "m", waits.append, 3, 1.0)
    assert (n, waited, err) == (2, 1.0, None)
    out, n, waited, err = _call_with_retry(flaky(["ThrottlingException"] * 5), "p", "s", "m", waits.append, 3, 1.0)
    assert (out, n, waited, err) == (None, 3, 7.0, "ThrottlingException")
    out, n, waited, err = _call_with_retry(flaky(["ValidationException"]), "p", "s", "m", waits.append, 3, 1.0)
    assert (out, n, waited, err) == (None, 1, 0.0, "ValidationException")


def test_prompt_layout_and_offline_scorer(spark):
    rows = [("r", 1, "a.py", "python", "+x = 1", 0, 2), ("r", 2, "b.go", "go", "", 0, 2)]
    df = spark.createDataFrame(rows, "review_id string, ordinal long, path string, language string, patch string, chunk_index long, total_chunks long")
    prompt = chunk_prompts(df).first().prompt
    assert prompt == (
        "Review this code diff (chunk 1/2):\n\n"
        "### File: a.py (language: python)\n```diff\n+x = 1\n```\n\n"
        "### File: b.go (language: go)\n```diff\n\n```\n"
    )
    from revlens import rules

    reply = OfflineScorer(inject_failures=False)(prompt, rules.REVIEWER_PROMPTS["security"], "m")
    assert '"file": "a.py"' in reply["text"] and '"b.go"' not in reply["text"]  # empty patch: no finding


def test_score_captures_errors_per_row(spark):
    rows = [(i, f"p{i}", "s", "m") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, prompt string, system_prompt string, model_id string")

    def factory():
        def scorer(prompt, system, model, temperature, max_tokens, request_key):
            assert (temperature, max_tokens, len(request_key)) == (0.1, 2048, 64)
            if prompt in ("p2", "p4"):
                raise ModelError("ValidationException")
            return {"text": prompt.upper(), "tokens_in": 3, "tokens_out": 2}

        return scorer

    got = {r.id: (r.text, r.error, r.attempts) for r in score(df, factory, sleep=lambda s: None).collect()}
    assert got[0] == ("P0", None, 1) and got[2] == (None, "ValidationException", 1) and got[4][1] == "ValidationException"
    scored = score(df, factory, sleep=lambda s: None)
    assert scored.filter(F.col("error").isNull()).count() == 4
    assert "prompt" not in scored.columns and "system_prompt" not in scored.columns


def test_reviewers_share_a_prompt_row(spark):
    df = spark.createDataFrame([("r", 0, 1, 1, "p")], "review_id string, chunk_index long, total_chunks long, n_files long, prompt string")
    own = [("mine", "other", "review.mine", "be kind", "keep_prefix", "m-1"), ("yours", "other", "review.yours", "be strict", "keep_prefix", "m-2")]

    def factory():
        return lambda prompt, system, model, temperature, max_tokens, request_key: {"text": f"{system}|{model}|{temperature}|{request_key[:0]}"}

    got = {r.agent: r.text for r in score_chunks(df, factory, reviewers=own, temperature=0.7).collect()}
    assert got == {"mine": "be kind|m-1|0.7|", "yours": "be strict|m-2|0.7|"}


def test_rate_limit_is_shared_by_the_tasks():
    from revlens.operators.score import _Pace

    waits = []
    pace = _Pace(10.0, 5, waits.append)
    for _ in range(3):
        pace.wait()
    assert len(waits) == 2 and waits[0] <= 0.5 < waits[1]


def test_prompts_do_not_call_the_model(spark):
    from revlens.plans.batch import review_batch

    schema = ("review_id string, ordinal long, filename string, status string, additions long, deletions long, "
              "patch string, previous_filename string")
    files = spark.createDataFrame([("r", 1, "a.py", "modified", 5, 5, "+x", None)], schema)

    def factory():
        raise AssertionError("the model was called")

    assert review_batch(files, factory).prompts.count() == 1


def test_pipeline_on_empty_and_all_generated_input(spark):
    from revlens.plans.batch import review_batch
    from revlens.plans.offline import no_sleep, offline_scorer_factory

    schema = ("review_id string, ordinal long, filename string, status string, additions long, deletions long, "
              "patch string, previous_filename string")
    empty = review_batch(spark.createDataFrame([], schema), offline_scorer_factory, sleep=no_sleep)
    assert empty.comments.count() == 0 and empty.findings.count() == 0
    gen = spark.createDataFrame([("r", 1, "package-lock.json", "modified", 5, 5, "+x", None)], schema)
    b = review_batch(gen, offline_scorer_factory, sleep=no_sleep)
    stats = b.stats.first()
    assert (stats.total_files, stats.generated_files_filtered, stats.has_generated_files) == (0, 1, True)
    c = b.comments.first()
    assert c.verdict == "approve" and "*No critical issues found.*" in c.comment


def test_rate_holds_for_any_number_of_slots(spark):
    """With a rate, rows are dealt to exactly so many tasks as share it; without one they stay."""
    rows = spark.createDataFrame([(str(i), "s", "m", i) for i in range(200)], "prompt string, system_prompt string, model_id string, id long")
    few = rows.repartition(31)
    paced = score(few, OfflineScorer, sleep=lambda s: None, calls_per_second=1000.0, callers=3)
    assert paced.rdd.getNumPartitions() == 3 and paced.count() == 200
    assert score(few, OfflineScorer, sleep=lambda s: None).rdd.getNumPartitions() == 31
    chunks = rows.select(F.lit("r").alias("review_id"), F.col("id").alias("chunk_index"), "prompt")
    spread = score_chunks(chunks, OfflineScorer, sleep=lambda s: None, calls_per_second=1000.0, callers=5)
    assert spread.rdd.getNumPartitions() == 5 and spread.count() == 4 * 200


def test_batch_comments_in_pages(spark):
    from revlens.plans.batch import review_batch
    from revlens.plans.offline import no_sleep, offline_scorer_factory

    patch = "@@ -1 +1 @@\n" + "\n".join(f"+password = \"hunter2hunter{i}\"" for i in range(40))
    files = spark.createDataFrame(
        [("r", i, f"src/f{i}.py", "modified", 40, 0, patch, None) for i in range(3)],
        "review_id string, ordinal long, filename string, status string, additions long, deletions long, patch string, previous_filename string",
    )
    b = review_batch(files, offline_scorer_factory, sleep=no_sleep)
    pages = b.comment_pages(2000).orderBy("page").collect()
    assert len(pages) > 3 and "".join(p.text for p in pages) == b.comments.first().comment
