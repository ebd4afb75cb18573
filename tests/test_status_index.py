"""The stored status index equals the batch form, whatever the order of the writes, and a
query reads one status' files."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from revlens.streaming import runner, sinks, snapshots, status_index

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def replayed(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        rid = f"r{i % 60}" if i % 3 else "hot"
        status = rnd.choice([None, "pending", "parsing_complete", "complete"])
        rows.append((rid, status, None if i % 41 == 0 else T0 + dt.timedelta(minutes=rnd.randrange(100_000)), f"{rnd.randrange(300):06d}"))
    rows += [("never", None, T0, "000001"), ("untimed", "complete", None, "000001")]
    writes = spark.createDataFrame(rows, "review_id string, status string, ts timestamp, write_order string")
    path = sinks.table_path(spark, "by-status-test")
    runner.replay(
        runner.in_drops(writes, F.concat("review_id", "write_order"), 12), "by-status-test",
        lambda w: status_index.index_changes(w, F.col("write_order")), sink=status_index.index_micro_batches(path), files=2, idle_batches=False,
    )
    want = {}
    for rid in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == rid]
        named = [(r[3], r[1]) for r in mine if r[1] is not None]
        times = [r[2] for r in mine if r[2] is not None]
        if named:
            want[rid] = (max(named)[1], min(times) if times else None)
    return path, want


def test_index_equals_batch(spark, replayed):
    path, want = replayed
    assert len(snapshots.versions(spark, path)) > 8  # it was merged on the way
    got = {}
    for status in ("pending", "parsing_complete", "complete", "unknown"):
        for r in status_index.with_status(spark, path, status).collect():
            assert r.review_id not in got, "a review has left its old place"
            got[r.review_id] = (r.status, r.created_at)
    assert got == want and "never" not in got and got["untimed"] == ("complete", None)


def test_pages_and_spans(spark, replayed):
    path, want = replayed
    complete = sorted((c, r) for r, (s, c) in want.items() if s == "complete" and c is not None)
    mid = complete[len(complete) // 2][0]
    first = status_index.with_status(spark, path, "complete", after=mid, limit=3).collect()
    assert [(r.created_at, r.review_id) for r in first] == [x for x in complete if x[0] >= mid][:3]
    early = status_index.with_status(spark, path, "complete", before=mid).collect()
    assert sorted((r.created_at, r.review_id) for r in early) == [x for x in complete if x[0] < mid]


def test_query_prunes_files_and_does_not_sort(spark, replayed):
    path, _ = replayed
    plan = status_index.with_status(spark, path, "complete", after=T0)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(status" in s and "(status" in s for s in scans)
    assert all("GreaterThanOrEqual(created_at" in s for s in scans)
    assert "Sort [" not in plan and "rangepartitioning" not in plan
    top = status_index.with_status(spark, path, "complete", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "rangepartitioning" not in top
