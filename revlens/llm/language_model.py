"""Gated recurrent language model with a class-factored softmax (operator 5).

log P(text) is the sum over tokens of log P(class | words so far) + log P(word | class).
The first factor is a recurrent network over classes (gru.py), the second comes from
counts of the whole training corpus, one added to each word and one left for unseen
words, so that both factors sum to one.

* Classes. A word's spelling (its first and last two bytes) picks one of `BUCKETS`
  buckets. Every bucket collects, over all training documents, a random projection of
  the documents it stands in; buckets of similar company become a class. So a class
  needs no word list, and words never seen have one.
* Network. All training documents are learned in rounds, a share each: every task
  learns its documents from the common weights, and the tasks' weights are averaged by
  their tokens.
* Counts. Words are 64-bit hashes. The most frequent ones are a list of bounded size
  that every task holds; all others are looked up by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import gru
from revlens.llm.common import arrow_texts, chunks, hashes_of, mix, stored, word_bounds

BUCKETS, PROJECTIONS, CLASSES = 4096, 16, 24
#: Words whose counts every task holds, at most (16 bytes each).
HEAD = 100_000
ROUNDS, RATE = 2, 0.01
#: Tokens that a task learns in one go.
LEARNED = 250_000
#: Distinct words that a task holds while it counts.
HELD = 1_000_000

#: A token of its own: the end of a document.
END = np.int64(-1)


def held_out(doc_id: Column) -> Column:
    """Rows not learned from; a null doc_id is no such row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _buckets(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spelling bucket of each word: of its first two and last two bytes."""
    u = np.uint64
    spelled = (
        raw[start].astype(u) | raw[np.minimum(start + 1, end - 1)].astype(u) << u(8)
        | raw[np.maximum(end - 2, start)].astype(u) << u(16) | raw[end - 1].astype(u) << u(24)
    )
    return mix(spelled) % u(BUCKETS)


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Spelling buckets of all words in order, and words per text."""
    raw, start, end, counts = word_bounds(texts)
    return _buckets(raw, start, end).astype(np.int64), counts


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: hash and spelling bucket; and words per text. A hash
    holds its bucket in the lowest bits, so that a count knows it."""
    raw, start, end, counts = word_bounds(texts)
    bucket = _buckets(raw, start, end)
    w = ((hashes_of(raw, start, end) & ~np.uint64(BUCKETS - 1)) | bucket).view(np.int64)
    return np.where(w == END, np.int64(-2), w), bucket.astype(np.int64), counts


def _projections() -> np.ndarray:
    """A row of signs per bucket, the same everywhere."""
    cells = np.arange(BUCKETS * PROJECTIONS, dtype=np.uint64) + np.uint64(0xC0FFEE)
    return np.where(mix(cells) & np.uint64(1), 1, -1).astype(np.int64).reshape(BUCKETS, PROJECTIONS)


_PAIRS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])


def _rows(kind: int, keys: np.ndarray, n: np.ndarray):
    return pa.record_batch([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n)], schema=_PAIRS)


def _gather(batches):
    """Of a task's training texts: counts of words and ends (kind 0), company of
    buckets (kind 1: one key per bucket and projection, whole numbers)."""
    signs, company = _projections(), np.zeros((BUCKETS, PROJECTIONS), np.int64)
    held, waiting, documents = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, 0

    def summed():
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

    for batch in batches:
        texts = arrow_texts(batch.column("text"))
        documents += len(texts)
        for first, last in chunks(texts):
            w, bucket, counts = words_of(texts[first:last])
            if not len(w):
                continue
            held.append(np.unique(w, return_counts=True))
            waiting += len(held[-1][0])
            if waiting > HELD:
                held, waiting = [summed()], 0
                if len(held[0][0]) > HELD:
                    yield _rows(0, *held[0])
                    held = [(held[0][0][:0], held[0][1][:0])]
            text = np.repeat(np.arange(len(counts)), counts)
            for p in range(PROJECTIONS):
                total = np.bincount(text, signs[bucket, p], len(counts))
                mean = np.rint(1024 * total / np.maximum(counts, 1)).astype(np.int64)
                company[:, p] += np.bincount(bucket, mean[text], BUCKETS).astype(np.int64)
    keys, n = summed()
    yield _rows(0, np.append(keys, END), np.append(n, documents))
    at = np.flatnonzero(company.ravel())
    yield _rows(1, at, company.ravel()[at])


def cluster(company: np.ndarray, weight: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each bucket: weighted k-means over the buckets' mean company."""
    seen = weight > 0
    x = np.zeros(company.shape)
    x[seen] = company[seen] / weight[seen, None] / 1024
    mean = np.average(x, axis=0, weights=weight + 1e-9)
    x = x - mean
    centre = x[np.argsort(-weight, kind="stable")[:1]]
    while len(centre) < classes:  # the next centre: far from all, and of weight
        gap = ((x[:, None] - centre[None]) ** 2).sum(2).min(1) * np.sqrt(weight)
        centre = np.concatenate((centre, x[[int(np.argmax(gap))]]))
    for _ in range(30):
        label = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for c in range(classes):
            mine = (label == c) & seen
            if mine.any():
                centre[c] = np.average(x[mine], axis=0, weights=weight[mine])
    return label


def _learn(class_of: np.ndarray, flat: np.ndarray, rate: float):
    schema = pa.schema([("tokens", pa.int64()), ("weights", pa.list_(pa.float64()))])

    def run(batches):
        trainer, held = gru.Trainer(flat, CLASSES, rate), []
        for batch in batches:
            texts = arrow_texts(batch.column("text"))
            for first, last in chunks(texts):
                bucket, counts = buckets_of(texts[first:last])
                held.append(np.insert(class_of[bucket], np.cumsum(counts), CLASSES))
                if sum(map(len, held)) > LEARNED:
                    trainer.learn(np.concatenate(held))
                    held = []
        if held:
            trainer.learn(np.concatenate(held))
        if trainer.tokens:
            yield pa.record_batch([pa.array([trainer.tokens]), pa.array([trainer.flat.astype(float).tolist()])], schema=schema)

    return run


def train(texts: DataFrame, class_of: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after `rounds` rounds over disjoint shares of `texts` (uid, text)."""
    flat = gru.initial(CLASSES, share)
    for i in range(rounds):
        part = texts.where(F.pmod(F.xxhash64("share"), F.lit(rounds)) == i).select("text")
        learned = part.mapInArrow(_learn(class_of, flat, RATE / (i + 1)), "tokens long, weights array<double>")
        mean = learned.select("tokens", F.posexplode("weights").alias("at", "w")).groupBy("at").agg(
            (F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w")
        ).collect()  # one row per weight
        if mean:
            flat = np.array([r["w"] for r in sorted(mean)], np.float32)
    return flat


_SCORED = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
    ("base", pa.float64()), ("score", pa.float64()), ("word", pa.int64()), ("n", pa.int64()),
])


def _score(class_of, flat, head, n_total, vocabulary, class_tokens, class_words):
    """A row per document with all that the network and the head of the vocabulary
    say, and rows (uid, word, n) of words that are to be looked up."""

    def run(batches):
        known, count = head.value
        base_floor = np.log10(float(n_total + vocabulary + 1))
        class_floor = np.log10(class_tokens + class_words + 1.0)
        for batch in batches:
            texts = arrow_texts(batch.column("text"))
            uids = batch.column("uid").to_numpy()
            labels, parts = [], []
            for first, last in chunks(texts):
                w, bucket, counts = words_of(texts[first:last])
                label, size = class_of[bucket], last - first
                labels += np.split(label.astype(np.int16), np.cumsum(counts)[:-1])
                text = np.repeat(np.arange(size), counts)
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                in_head = known[at] == w if len(known) else np.zeros(len(w), bool)
                gain = np.where(in_head, np.log10(count[at] + 1.0), 0.0) if len(known) else np.zeros(len(w))
                heads = np.bincount(text, in_head, size).astype(np.int64) + int(class_tokens[CLASSES] > 0)
                parts.append((counts + 1, heads, np.bincount(text, gain, size), np.bincount(text, class_floor[label], size)))
                rest = ~in_head
                if rest.any():
                    order = np.lexsort((w[rest], text[rest]))
                    t, v = text[rest][order], w[rest][order]
                    new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1]))))
                    m = np.diff(np.append(new, len(t)))
                    empty = [pa.nulls(len(new), f.type) for f in _SCORED]
                    empty[0], empty[7], empty[8] = pa.array(uids[first:last][t[new]]), pa.array(v[new]), pa.array(m.astype(np.int64))
                    yield pa.record_batch(empty, schema=_SCORED)
            if not parts:
                continue
            n, heads, gain, floors = (np.concatenate(x) for x in zip(*parts, strict=True))
            # the network takes all documents of the batch side by side
            net = gru.log_likelihood(flat, CLASSES, labels) / np.log(10)
            base = gain + np.log10(class_tokens[CLASSES] + 1.0) - n * base_floor
            null = pa.nulls(len(n), pa.int64())
            yield pa.record_batch(
                [batch.column("uid"), batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)),
                 pa.array(heads), pa.array(base), pa.array(net + gain - floors), null, null],
                schema=_SCORED,
            )

    return run


def _head(counted: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Words (sorted) and counts of the most frequent words, `most` at most: all whose
    count passes the least threshold that so few pass."""
    words = counted.where(F.col("key") != int(END))
    # counts fall into steps of a quarter octave: a few hundred rows
    step = F.floor(4 * F.log2("n")).cast("int")
    steps = sorted(words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    least, held = None, 0
    for r in steps:
        held += r["words"]
        if held > most:
            break
        least = r["s"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = words.where(step >= least).toArrow()  # `most` rows at most
    keys, n = (np.asarray(top.column(c).combine_chunks()) for c in ("key", "n"))
    order = np.argsort(keys, kind="stable")
    return keys[order], n[order]


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities).

    Null and empty texts are scored as an end alone. Null doc_ids are learned from;
    repeated rows count as often as they stand. Without training rows every word is
    unknown and the network keeps its start weights. An empty table gives an empty
    result. Only doc_id and text are read; long texts are scored whole, with the
    state carried through.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    training = texts.where(~F.col("held_out"))
    pairs = training.select("text").mapInArrow(_gather, "kind byte, key long, n long")
    summed = stored(pairs.groupBy("kind", "key").agg(F.sum("n").alias("n")), "words")
    counted = summed.where("kind = 0 AND n > 0").select("key", "n")
    company = np.zeros(BUCKETS * PROJECTIONS)
    for r in summed.where("kind = 1").collect():  # BUCKETS * PROJECTIONS rows at most
        company[r["key"]] = r["n"]
    bucket = F.col("key").bitwiseAND(F.lit(BUCKETS - 1))
    # tokens and words of each bucket, and of the end apart: BUCKETS + 1 rows at most
    per_bucket = counted.groupBy(F.when(F.col("key") == int(END), F.lit(-1)).otherwise(bucket).alias("b")).agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")
    ).collect()
    tokens, words, n_ends = np.zeros(BUCKETS), np.zeros(BUCKETS), 0
    for r in per_bucket:
        if r["b"] < 0:
            n_ends = r["tokens"]
        else:
            tokens[r["b"]], words[r["b"]] = r["tokens"], r["words"]
    class_of = cluster(company.reshape(BUCKETS, PROJECTIONS), tokens)
    class_tokens = np.append(np.bincount(class_of, tokens, CLASSES), n_ends)
    class_words = np.append(np.bincount(class_of, words, CLASSES), float(n_ends > 0))
    n_total, vocabulary = int(class_tokens.sum()), int(class_words.sum())
    flat = train(training.withColumn("share", F.coalesce("doc_id", F.lit(0).cast("long"))), class_of, class_tokens / max(1, n_total))
    top = _head(counted)
    head = spark.sparkContext.broadcast(top)
    scored = stored(
        texts.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
            _score(class_of, flat, head, n_total, vocabulary, class_tokens, class_words),
            "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word long, n long",
        ),
        "scored",
    )
    rest = scored.where("word IS NOT NULL").select("uid", "word", F.col("n").alias("times"))
    found = rest.join(counted, rest["word"] == counted["key"]).groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain"), F.sum("times").alias("more")
    )
    out = scored.where("word IS NULL").drop("word", "n").join(found, "uid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
