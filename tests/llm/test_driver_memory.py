"""Sides of joins that grow with the data stay out of the driver."""

from __future__ import annotations

from revlens.llm import jaccard
from revlens.llm.components import connected_components

TEXT = "one two three four five six seven eight nine ten eleven twelve"


def test_copies_are_no_broadcast_table_and_exact_beyond_doubles(spark):
    """Ids a double cannot tell apart, null ids and texts, and columns as they are."""
    big = 1 << 60
    rows = [(big, TEXT, "a"), (big + 1, TEXT, "b"), (big + 2, "other " + TEXT[::-1], "c"), (None, TEXT, "d"), (5, None, "e"), (6, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert "BroadcastExchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.extra for r in kept.collect()) == ["a", "c", "d", "e", "f"]
    alone = jaccard.one_of_each(docs.where("extra IN ('a', 'c')"))
    assert sorted(r.extra for r in alone.collect()) == ["a", "c"]


def test_joins_of_what_grows_are_shuffled(spark):
    shared = spark.createDataFrame([(1, 10, 9), (1, 11, 9), (2, 11, 9), (2, 12, 9)], "key long, class long, n int")
    labels = spark.createDataFrame([(10, 10), (11, 10)], "node long, component long")
    rows = jaccard._open(shared, labels)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    assert sorted((r["key"], r["class"], r["label"]) for r in rows.collect()) == [(2, 11, 10), (2, 12, 12)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 12)], "u long, v long")
    assert {r.component for r in connected_components(edges).collect()} == {0}
