"""Every branch of the main operators is exercised by the derived inputs at
sf0.01 (counts checked once against the DuckDB oracle)."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL


@pytest.fixture(scope="module")
def q(spark):
    from revlens.plans.registry import QUERIES, load_all

    load_all()
    return lambda key: QUERIES[key](spark, SMALL)


def counts(df, col):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_verdict_branches(q):
    assert counts(q("verdict"), "verdict") == {"request_changes": 90, "comment": 45, "approve": 15}
    assert counts(q("seen_agents"), "seen_agents") == {4: 105, 3: 30}


def test_barrier_branches(q):
    got = {(r.complete, r.seen_agents): r["count"] for r in q("completion_barrier").groupBy("complete", "seen_agents").count().collect()}
    assert got == {(True, 4): 105, (False, 3): 30}


def test_admission_branches(q):
    got = counts(q("admission_route"), "outcome")
    assert set(got) == {
        "accepted", "bad_body", "bad_signature", "ignored_action", "ignored_event", "invalid_event", "invalid_json",
    }


def test_message_and_reply_branches(q):
    assert set(counts(q("dead_letter_route"), "route")) == {"acked", "dead", "retry"}
    assert set(counts(q("score_error_isolation"), "outcome")) == {"ok", "bad_json", "invalid"}
    assert set(counts(q("score_chunks"), "outcome")) == {"ok", "bad_json", "model_error"}


def test_every_secret_rule_hits(q):
    from revlens import rules

    msgs = counts(q("secret_scan"), "message")
    assert set(msgs) == {name + rules.SECRET_MESSAGE_SUFFIX for name, _, _ in rules.SECRET_RULES}
