"""Hot keys: one review holds most of the rows. The skew-safe operators must
stay exact while no task holds the whole key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators.chunk import assign_chunks
from revlens.operators.ordering import first_by_order, row_position
from tests.test_chunk_scan import py_chunks


def test_hot_review_chunk_tree(spark):
    rnd = random.Random(21)
    hot = [rnd.choice([0, 3, 40, 260, 499, 501, 1200]) for _ in range(20000)]
    cold = [rnd.choice([10, 300]) for _ in range(50)]
    rows = [("hot", i, n, 0) for i, n in enumerate(hot)] + [("cold", i, n, 0) for i, n in enumerate(cold)]
    df = spark.createDataFrame(rows, "review_id string, ordinal long, additions long, deletions long").repartition(16)
    # 64-file blocks and fan-in 8: 313 blocks -> 40 -> 5 nodes, a three-level tree
    got = assign_chunks(df, block_files=64, fan_in=8).select("review_id", "ordinal", "chunk_index", "total_chunks")
    hot_got = [r.chunk_index for r in got.filter("review_id = 'hot'").orderBy("ordinal").collect()]
    want = py_chunks(hot)
    assert hot_got == want
    assert got.filter("review_id = 'hot'").select(F.max("total_chunks")).first()[0] == max(want) + 1
    assert [r.chunk_index for r in got.filter("review_id = 'cold'").orderBy("ordinal").collect()] == py_chunks(cold)


def test_hot_key_row_position_spans_tasks(spark):
    n_hot = 30000
    rows = [("hot", i) for i in range(n_hot)] + [(f"k{i % 7}", i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o long").repartition(8)
    out = row_position(df, ["k"], ["o"], num_partitions=16)
    hot = out.filter("k = 'hot'")
    assert hot.filter(F.col("position") != F.col("o")).count() == 0
    # the hot key takes several tasks, not one (small partitions are not merged here)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = hot.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread > 1

    cold = out.filter("k <> 'hot'").groupBy("k").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count("*").alias("n"))
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in cold.collect())

def test_row_position_refuses_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, o long")
    with pytest.raises(Exception, match="rows tie"):
        row_position(df, ["k"], ["o"], num_partitions=4).collect()


def test_hot_key_first_row_is_partial_aggregate(spark):
    rows = [("hot", i % 1000, -i) for i in range(50000)] + [("c", 1, 5), ("c", 0, 7)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(8)
    got = {r.k: (r.o, r.v) for r in first_by_order(df, ["k"], ["o", "v"]).collect()}
    assert got == {"hot": (0, -49000), "c": (0, 7)}
    plan = first_by_order(df, ["k"], ["o", "v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") >= 2  # partial aggregate below the exchange
