"""Quality classifier (operator 12): hashed word n-grams, logistic regression by FTRL.

A text is cut into runs of letters and digits and runs of other signs, a word that
repeats the one or two before it becomes a mark; runs of one to `GRAMS` words are hashed into 2**`BITS` places, and a document is the sparse vector of
their dampened counts, of length one. Weights are learned by follow-the-regularised-leader
updates, one labelled document after the other, in a fixed order: `EPOCHS` copies of the
sample, each in an order of its own, stream through one task that holds the weights alone.
A score is the logistic curve of a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import arrow_texts, chunks, hashes_of, mix

BITS, GRAMS = 18, 2
#: Labelled documents that are learned from, at most.
FIT_ROWS = 10_000
EPOCHS = 3
#: Step size, its dampening, and the two penalties; all chosen by cross-validation inside
#: the rows that may be learned from.
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.2, 0.1

#: 0 white space, 1 letters and digits (all of non-ASCII too), 2 other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of one class of all texts, in order, and each text's number
    of runs."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _CLASS[raw]
    edge = np.flatnonzero(np.diff(kind)) + 1
    start = np.concatenate(([0], edge))
    end = np.concatenate((edge, [len(raw)]))
    word = kind[start] > 0
    start, end = start[word], end[word]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes_of(raw, start, end), np.diff(np.searchsorted(start, ends), prepend=0)


def features(texts: list[bytes], bits: int = BITS, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, counts, entries of each text) of the texts' n-grams; a text without
    words has no entry."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, counts = token_hashes(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    plain = h.copy()
    for back in (2, 1):  # repeated words are alike, whatever the word
        again = (plain[back:] == plain[:-back]) & (owner[back:] == owner[:-back])
        h[back:][again] = np.uint64(back)
    run, keys = h, []
    for k in range(grams):
        if k:
            run = mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
            inside = owner[k:] == owner[: len(run)]
        else:
            inside = np.ones(len(run), bool)
        place = (mix(run + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)
        keys.append(((owner[: len(run)] << bits) | place)[inside])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key & ((1 << bits) - 1), n, np.bincount(key >> bits, minlength=len(texts))


def values(counts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Values of sparse vectors: dampened counts, each text's vector of length one."""
    value = 1 + np.log(counts)
    of = np.repeat(np.arange(len(entries)), entries)
    return value / np.sqrt(np.bincount(of, value**2, len(entries)))[of]


class Ftrl:
    """Follow the regularised leader, per place: sums of gradients `z` and of their
    squares `n` are all there is; weights follow from them. Place 2**bits is the bias,
    which is not penalised."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> float:
        at = np.append(places, len(self.z) - 1)
        x = np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        squares = self.n[at]
        more = squares + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(squares)) / ALPHA * w
        self.n[at] = more
        return float(p)


def dot_products(places: np.ndarray, value: np.ndarray, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The logistic curve of each sparse vector's product with `weights`."""
    of = np.repeat(np.arange(len(entries)), entries)
    x = np.bincount(of, weights[places] * value, len(entries)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a null doc_id is no such row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, learns: Column, rows: int = FIT_ROWS) -> DataFrame:
    """(id, label, text) of at most `rows` labelled documents, by the hash of their id.
    A doc_id with several labels counts as 1 only if all of them are; of several texts
    with one doc_id the one of the least hash is taken."""
    known = labels.where(learns & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") > 0).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    one = F.min_by("text", F.xxhash64("text"))
    return texts.groupBy("id").agg(F.first("label").alias("label"), one.alias("text"))


def _entries(batches):
    """Sparse vectors of the texts: places and counts."""
    for batch in batches:
        texts = arrow_texts(batch.column("text"))
        for first, last in chunks(texts):
            places, counts, entries = features(texts[first:last])
            offsets = pa.array(np.concatenate(([0], np.cumsum(entries))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (places, counts)]
            part = batch.slice(first, last - first)
            yield pa.record_batch([part.column("id"), part.column("label"), *lists], names=["id", "label", "places", "counts"])


def _train(batches):
    """Streams vectors in their order through the updates; the weights that are not 0."""
    model = Ftrl()
    for batch in batches:
        labels = batch.column("label").to_pylist()
        places, counts = batch.column("places"), batch.column("counts")
        for i, label in enumerate(labels):
            n = counts[i].values.to_numpy()
            model.learn(places[i].values.to_numpy(), values(n, np.array([len(n)])), label)
    w = model.weights()
    at = np.flatnonzero(w)
    yield pa.record_batch([pa.array(at), pa.array(w[at])], names=["place", "weight"])


def fit(docs: DataFrame, labels: DataFrame, learns: Column, rows: int = FIT_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all places and the bias (last). Texts become vectors in all tasks;
    the updates, which follow one another, run in one task over the bounded sample."""
    picked = sample(docs, labels, learns, rows)
    id_type = picked.schema["id"].dataType.simpleString()
    vectors = picked.mapInArrow(_entries, f"id {id_type}, label int, places array<int>, counts array<int>")
    copies = vectors.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = copies.withColumn("o", F.xxhash64("epoch", F.col("id").cast("string")))
    stream = order.repartition(1).sortWithinPartitions("epoch", "o", "id").select("label", "places", "counts")
    learned = stream.mapInArrow(_train, "place long, weight double").collect()  # at most 2**BITS + 1 rows
    w = np.zeros((1 << BITS) + 1)
    w[[r["place"] for r in learned]] = [r["weight"] for r in learned]
    return w


def score(text: Column, weights: np.ndarray) -> Column:
    """Score of a text column, 0 to 1; a null text scores as an empty one."""
    at = np.flatnonzero(weights)
    small = (at.astype(np.int32), weights[at], len(weights))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        places, w, n = small
        dense = np.zeros(n)
        dense[places] = w
        raw = ["".encode() if t is None else t.encode() for t in texts]
        out = [np.zeros(0)]
        for first, last in chunks(raw):
            at, counts, entries = features(raw[first:last])
            out.append(dot_products(at, values(counts, entries), entries, dense))
        return pd.Series(np.concatenate(out))

    return run(text)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Every text is scored whole; null and empty texts and texts without words get the
    score of the bias alone. Null or missing labels are not learned from; without any
    label all scores are 0.5. Repeated rows score alike; an empty table gives an empty
    result. Only doc_id and text, and doc_id and quality of `labels`, are read.
    """
    weights = fit(docs, labels, ~held_out(F.col("doc_id")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
