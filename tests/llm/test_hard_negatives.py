"""Hard negatives against a brute-force version; the tree against whole scans."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=5):
    """Rows (vec_id, vector, label), by their place."""
    part = []
    for i, (v, x, y) in enumerate(rows):
        if y is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        part.append((i, v, (y + 1) % 10 if v is not None and v % 7 == 0 else y, [math.floor(256 * float(c)) for c in x]))
    first = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for i, v, y, x in part:
        if v is None or v % 100:
            continue
        scores = [(sum(a * b for a, b in zip(x, z, strict=False)), w, j, l == y) for j, w, l, z in part if j != i]
        for ps, p, *_ in sorted((s for s in scores if s[3]), key=first)[:positives]:
            bad = [s for s in scores if not s[3] and 80 * ps <= 100 * s[0] <= 100 * ps]
            out += [(v, p, k, s[1], ps, s[0]) for k, s in enumerate(sorted(bad, key=first)[:negatives], 1)]
    return out


def got(df, **kw):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hn.mine_hard_negatives(df, relabel=label, **kw).collect()
    return sorted(map(key, rows))


def key(r):
    return tuple((x is None, x or 0) for x in r)


def vectors(seed, n, dims, spread, centres=6):
    r = random.Random(seed)
    mid = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    out = []
    for i in range(n):
        c = r.choice(mid)
        out.append((i, [float(np.float32(x + r.gauss(0, spread))) for x in c], r.choice([1, 1, 1, 0, 2, 9])))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed,n,dims,spread", [(1, 900, 8, 0.2), (2, 700, 64, 0.5), (3, 600, 1, 0.1), (4, 800, 3, 0.01)])
def test_equal_to_brute_force(spark, monkeypatch, seed, n, dims, spread):
    monkeypatch.setattr(hn, "SHARD_ROWS", 150)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hn, "PASS_BLOCKS", 2)
    rows = vectors(seed, n, dims, spread)
    want = brute(rows)
    assert want and got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == sorted(map(key, want))


def test_ties_copies_and_bad_rows(spark):
    rows = vectors(7, 260, 4, 0.3)
    same = rows[5][1]
    rows += [(300 + i, same, 3) for i in range(120)]  # one vector, many rows: ties by vec_id
    rows += [(450, None, 1), (500, same, None), (600, [1.0, None, 2.0, 3.0], 1), (700, [float("nan")] * 4, 1), (800, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [(1000, rows[0][1], 1), (1100, [], 1), (1200, [1.0], 2), (1300, [2.0, 1.0, 0.5, 0.25, 8.0, 3.0], 1), (-200, same, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.select("*", F.lit(1).alias("uid"), F.lit(2).alias("q"), F.lit(3).alias("block"), F.lit(4).alias("score"), F.lit(5).alias("rank"))
    assert got(df) == sorted(map(key, brute(rows)))


def test_null_ids_and_repeated_ids(spark):
    rows = vectors(9, 150, 4, 0.3) + [(None, vectors(9, 150, 4, 0.3)[i][1], 1) for i in range(20)]
    rows += [rows[100], rows[100], rows[3]]
    want = brute(rows)
    have = got(spark.createDataFrame(rows, SCHEMA))
    assert have == sorted(map(key, want))


def test_empty_and_no_anchors(spark):
    df = spark.createDataFrame(vectors(1, 50, 3, 0.2), SCHEMA)
    assert hn.mine_hard_negatives(df.where("false")).collect() == []
    assert hn.mine_hard_negatives(df.where("vec_id > 0")).collect() == []
    assert hn.mine_hard_negatives(df.where("vec_id = 0")).collect() == []


def test_large_numbers(spark):
    rows = [(i, [2.0**40 * (1 + i % 5), -(2.0**38) * (i % 3)], i % 2) for i in range(0, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    have = hn.mine_hard_negatives(df.select(*df.columns), relabel=label).collect()
    assert have == []  # products beyond 64 bits are left out
    rows = [(i, [2.0**20 * (1 + i % 5) + i, -(2.0**19) * (i % 3)], i % 2) for i in range(0, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(df) == sorted(map(key, brute(rows)))


def test_boxes_hold_their_rows_and_prune():
    r = np.random.default_rng(3)
    centres = r.normal(0, 300, (40, 6))
    q = np.floor(centres[r.integers(0, 40, 6000)] + r.normal(0, 8, (6000, 6))).astype(np.int64)
    q = q[hn.str_order(q)]
    ids = np.arange(6000)
    tree = hn.Tree(ids, ids, np.zeros(6000, np.int64), q)
    lo, hi, *_ = tree.levels[0]
    for i in range(0, len(lo), 17):
        part = q[i * hn.LEAF_ROWS : (i + 1) * hn.LEAF_ROWS]
        assert (part >= lo[i]).all() and (part <= hi[i]).all()
    assert len(tree.levels[-1][0]) == 1
    read = []
    whole = tree._first
    tree._first = lambda at, s, k: read.append(len(at)) or whole(at, s, k)
    at, scores = tree.search(q[10], -1, 1, True, [-(2**40)], [2**40], 5)[0]
    assert sorted(scores, reverse=True) == sorted((q @ q[10]).astype(float), reverse=True)[:5]
    assert sum(read) < 3000  # less than half of the rows were read


@pytest.mark.parametrize("last", [1, 3])
def test_plan_has_no_cross_join(spark, last):
    rows = hn.quantised(spark.createDataFrame(vectors(1, 300, 3, 0.2), SCHEMA))
    asked = rows.select("*", (F.col("uid") % 3).cast("int").alias("block"), F.array(F.lit(0)).alias("lows"), F.array(F.lit(1)).alias("highs"))
    pairs = hn._pairs(hn.packed_trees(rows, 300), hn.anchor_blocks(asked, 1), 0, last)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Cartesian" not in text and "NestedLoop" not in text
