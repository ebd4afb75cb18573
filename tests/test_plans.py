"""Physical-plan properties the design relies on (checked with the executed
plan, the same thing `.explain("formatted")` prints)."""

from __future__ import annotations

import pytest

from tests.conftest import SMOKE


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def q(spark):
    from revlens.plans.registry import QUERIES, load_all

    load_all()
    return lambda key: QUERIES[key](spark, SMOKE)


def test_secret_scan_is_row_local(q):
    p = plan(q("secret_scan"))
    assert "hashpartitioning" not in p and "rangepartitioning" not in p
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_time_window_pushed_to_scan(q):
    p = plan(q("function_metrics_24h"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p


def test_partial_aggregation_before_shuffle(q):
    for key in ("pr_stats", "severity_counts_review", "dedupe_cross_reviewer"):
        p = plan(q(key))
        assert p.count("Aggregate") >= 2, key  # partial + final around the exchange


def test_no_python_udfs_outside_user_code(q):
    for key in ("admission_route", "findings_parse", "verdict", "review_comment_render", "detect_language"):
        p = plan(q(key))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key


def test_chunk_packing_runs_in_the_jvm_and_moves_no_text(q):
    for key in ("chunk_pack", "chunk_assign"):
        p = plan(q(key))
        assert "Pandas" not in p and "Python" not in p, key
        assert "patch" not in p[p.index("Exchange"):].split("Project")[0], key
    df = q("chunk_assign")
    df.collect()
    ran = plan(df).split("== Initial Plan ==")[0]
    assert ran.count("ReusedExchange") == 1


def test_topk_is_take_ordered(q):
    assert "TakeOrderedAndProject" in plan(q("recent_reviews_topk"))


def test_fixed_tables_are_stacked_not_joined(q):
    """An outer join can only build its null-supplying side, so the fixed names are
    stacked under the aggregates instead: no outer join, and nothing to broadcast."""
    for key in ("queue_depth_left_join", "function_metrics_left_join"):
        p = plan(q(key))
        assert "RightOuter" not in p and "LeftOuter" not in p and "FullOuter" not in p, key


def test_store_lookups_prune_and_push_down(q):
    p = plan(q("key_lookup"))
    assert "PartitionFilters: [isnotnull(pk_bucket" in p and "EqualTo(pk,REV#rev-7)" in p
    p = plan(q("sk_prefix_scan"))
    assert "StringStartsWith(sk,FINDING#security#)" in p


def test_no_cross_joins(q):
    for key in ("fan_out", "review_event_assemble", "overview_kpi", "review_pipeline_batch"):
        p = plan(q(key))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key
