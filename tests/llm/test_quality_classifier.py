"""Quality classifier: updates against a plain loop, held-out accuracy, edges."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from revlens.llm import quality_classifier as qc
from revlens.llm import queries

SF = "/root/testdata/sf0.1"
RUN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+")


def runs_of(text):
    """Runs of a text, a word that repeats the one or two before it as a number."""
    w = RUN.findall(text)
    return [1 if i and w[i] == w[i - 1] else 2 if i > 1 and w[i] == w[i - 2] else x for i, x in enumerate(w)]


def test_features_count_ngrams():
    texts = ["the cat, the cat && sat sat sat", "", "  \n ", "Ünï-code x x y x y", "a" * 5000]
    places, counts, entries = qc.features([t.encode() for t in texts], bits=30, grams=2)
    at = np.concatenate(([0], np.cumsum(entries)))
    for i, t in enumerate(texts):
        w = runs_of(t)
        want = collections.Counter([(x,) for x in w] + list(zip(w, w[1:], strict=False)))
        assert sorted(counts[at[i] : at[i + 1]]) == sorted(want.values())
        assert len(set(places[at[i] : at[i + 1]])) == entries[i]
    v = qc.values(counts, entries)
    assert all(math.isclose((v[at[i] : at[i + 1]] ** 2).sum(), 1.0) for i in (0, 3, 4))


def test_features_do_not_depend_on_neighbours():
    texts = [b"a b c", b"", b"c a", b"x! y! z!"]
    together = qc.features(texts)
    alone = [qc.features([t]) for t in texts]
    assert np.array_equal(together[0], np.concatenate([a[0] for a in alone]))
    assert np.array_equal(together[1], np.concatenate([a[1] for a in alone]))


def test_updates_equal_plain_loop():
    rng = np.random.default_rng(5)
    model, z, n = qc.Ftrl(bits=4), collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= qc.L1:
            return 0.0
        return -(z[i] - math.copysign(qc.L1, z[i])) / ((qc.BETA + math.sqrt(n[i])) / qc.ALPHA + qc.L2)

    for _ in range(200):
        at = np.sort(rng.choice(16, 5, replace=False))
        x, y = rng.random(5), int(rng.random() < 0.4)
        p = model.learn(at, x, y)
        pairs = [*zip(at.tolist(), x.tolist(), strict=True), (16, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        want = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
        assert math.isclose(p, want, rel_tol=1e-9)
        for i, v in pairs:
            g = (want - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / qc.ALPHA * w[i]
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(17)])


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op12_ngram_quality_classifier"](spark, SF).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    told = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in told) / len(told) > 0.98
    assert sum(p for p, y in told if y) / sum(y for _, y in told) > 0.99


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(0))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    a = sorted((r.doc_id, r.score) for r in qc.quality(docs, labels).collect())
    assert a == sorted((r.doc_id, r.score) for r in qc.quality(other, turned).repartition(3).collect())


def test_edges(spark):
    rows = [(1, "good words here"), (2, "b&& a&& d&&"), (3, None), (4, ""), (5, " \n"), (6, "w " * 50_000), (7, "x" * 100_000),
            (8, "good words here"), (8, "good words here"), (None, "good words here"), (10, "日本")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("id"), F.lit("z").alias("label"), F.lit(0).alias("quality"))
    known = [(1, 1), (2, 0), (2, 1), (3, 1), (6, 0), (7, None), (8, 1), (None, 1), (99, 1), (4, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int").select("*", F.lit("t").alias("text"))
    out = qc.quality(docs, labels).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.score)
    assert by[3] == by[4] == by[5] and len(by[8]) == 1 and by[8] == by[None] == by[1]
    assert {r.score for r in qc.quality(docs, labels.where("false")).collect()} == {0.5}
    assert qc.quality(docs.where("false"), labels).collect() == []
    assert [(r.id, r.label) for r in qc.sample(docs, labels, F.lit(True)).orderBy("id").collect()] == [(1, 1), (2, 0), (3, 1), (4, 1), (6, 0), (8, 1)]
    assert qc.sample(docs, labels, F.lit(True), rows=2).count() <= 2
