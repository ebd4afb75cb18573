"""Toxicity by compression distance (operator 3).

Three zstandard dictionaries are trained: one on the windows of ordinary texts, one on
the windows of toxic texts, and one on the telling runs of words of toxic texts alone.
Every window of a document is compressed with the ordinary dictionary, and with each
of the toxic ones before it; the bytes that a toxic one saves are the window's
distances. A logistic curve over a document's distances, fitted on labelled documents
that the dictionaries have not seen, gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import mix, word_hashes

WINDOW_WORDS = 16
#: Labelled rows of each class that are fitted on, at most, and their longest text.
FIT_ROWS, FIT_CHARS = 4_000, 20_000
#: Dictionary sizes. What toxic text has beyond ordinary text fits into little.
DICT_BYTES, TOXIC_BYTES = 1 << 16, 1 << 11
#: Short segments: of a toxic window, a word or two are toxic.
SEGMENTS = {"k": 16, "d": 6}
#: Words of a telling run, at most.
RUN_WORDS = 3
#: A thorough search with large tables: a hastier one finds other matches in the two
#: dictionaries, and that noise hides a saved word.
SEARCH = {
    "window_log": 17, "hash_log": 17, "chain_log": 17, "search_log": 6, "min_match": 4,
    "strategy": zstandard.STRATEGY_LAZY2,
    "write_content_size": False, "write_checksum": False, "write_dict_id": False,
}

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def windows(text: str | None, words: int = WINDOW_WORDS) -> list[bytes]:
    """All words of a text, lower-cased, in windows of `words`; whole words only."""
    w = _WORDS.findall((text or "").lower())
    return [" ".join(["", *w[i : i + words], ""]).encode("utf-8", "replace") for i in range(0, len(w), words)]


@dataclass(frozen=True)
class Model:
    """Dictionary contents (of toxic windows, of telling runs), the threshold of a
    telling window with each of these two, and the curve."""

    ordinary: bytes
    toxic: tuple[bytes, ...]
    thresholds: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self) -> list:
        out, search = [], zstandard.ZstdCompressionParameters(**SEARCH)
        for content in (self.ordinary, *[t + self.ordinary for t in self.toxic]):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=search)
            out.append(zstandard.ZstdCompressor(compression_params=search, dict_data=d))
        return out


def distances(compressors: list, text: str | None) -> np.ndarray:
    """Bytes that each toxic dictionary saves: a row per dictionary, a column per window."""
    plain, *both = (c.compress for c in compressors)
    out = []
    for w in windows(text):
        alone = len(plain(w))
        out.append([alone - len(c(w)) for c in both])
    return np.array(out, float).reshape(-1, len(both)).T


def features(d: np.ndarray, thresholds: tuple[float, ...]) -> np.ndarray:
    """Of a document's distances, with each toxic dictionary: the largest, the mean of
    the three largest, and how many windows pass the threshold, by number and by share."""
    out = [1.0]
    for row, threshold in zip(d, thresholds, strict=True):
        if len(row):
            top, over = np.sort(row)[::-1][:3], float((row >= threshold).sum())
            out += [top[0] / 4, top.sum() / 12, np.log1p(over), over / len(row)]
        else:
            out += [0.0] * 4
    return np.array(out)


def _content(samples: list[bytes], size: int, **segments) -> bytes:
    """A trained dictionary; of too little text to train on, the text itself."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, **segments).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _runs(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many words, of the words' hashes in order."""
    out = h
    for k in range(1, words):
        out = mix(out[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    return out


def unlike(texts: list[str], signs: int = 32, same: float = 0.75) -> list[str]:
    """Texts without near copies of earlier ones that stay: of `signs` least hashes of
    their three-word shingles, `same` or more are equal. Copies would make any word of
    theirs look frequent; all other texts stay."""
    salts = mix(np.arange(1, signs + 1, dtype=np.uint64))
    kept, n, out = np.zeros((len(texts), signs), np.uint64), 0, []
    for t in texts:
        h = word_hashes([t.encode("utf-8", "replace")])[0]
        if len(h):
            h = np.unique(_runs(h, min(3, len(h))))
            mins = np.array([mix(h ^ s).min() for s in salts])
            if n and (kept[:n] == mins).sum(1).max() >= same * signs:
                continue
            kept[n], n = mins, n + 1
        out.append(t)
    return out


def _word_hashes(text: str) -> tuple[list[str], np.ndarray]:
    """Words of letters, lower-cased, and their hashes."""
    w = _LETTERS.findall(text.lower())
    return w, word_hashes([" ".join(w).encode("utf-8", "replace")])[0]


def telling_runs(toxic: list[str], ordinary: list[str], least: float = 18.0) -> list[np.ndarray]:
    """Runs of 1 to RUN_WORDS words that are over-represented in toxic texts: their
    sorted hashes, by length. The log-likelihood ratio of their document counts is at
    least `least` (chance gives less to all of a large vocabulary)."""
    share = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
    bad, good = ([_word_hashes(t)[1] for t in texts] for texts in (toxic, ordinary))
    out = []
    for words in range(1, RUN_WORDS + 1):
        runs, a = np.unique(np.concatenate([np.unique(_runs(h, words)) for h in bad] or [np.zeros(0, np.uint64)]), return_counts=True)
        runs, a = runs[a >= 3], a[a >= 3]
        b = np.zeros(len(runs))
        for h in good if len(runs) else ():
            h = np.unique(_runs(h, words))
            at = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
            b[at[runs[at] == h]] += 1
        n = a + b
        ratio = 2 * (a * np.log(a / (n * share)) + b * np.log(np.maximum(b, 1) / (n * (1 - share))))
        out.append(runs[(a > n * share) & (ratio >= least)])
    return out


def _told(text: str, telling: list[np.ndarray]) -> bytes:
    """The words of a text that stand in a telling run."""
    w, h = _word_hashes(text)
    there = np.zeros(len(w), bool)
    for words, runs in enumerate(telling, 1):
        for at in np.flatnonzero(np.isin(_runs(h, words), runs)):
            there[at : at + words] = True
    return " ".join(["", *[x for x, t in zip(w, there, strict=True) if t], ""]).encode("utf-8", "replace")


def _logistic(x: np.ndarray, y: np.ndarray, sample: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (sample * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (sample * (y - p)) - ridge * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(texts: list[str], toxic: list[int], share: float) -> Model:
    """Model from labelled texts; `share` is the share of toxic ones at large. Three
    of four texts train the dictionaries, the others the curve. Without texts of both
    classes the score is `share` everywhere."""
    y = np.array(toxic, float)
    prior = float(np.clip(share, 1e-4, 1 - 1e-4))
    flat = Model(b"", (b"", b""), (1.0, 1.0), (float(np.log(prior / (1 - prior))), *[0.0] * 8))
    if len(y) == 0 or y.min() == y.max():
        return flat
    for_curve = np.arange(len(y)) % 4 == 3
    if not 0 < y[for_curve].sum() < for_curve.sum():
        for_curve = np.ones(len(y), bool)
    trains = ~for_curve if (~for_curve).any() and 0 < y[~for_curve].sum() < (~for_curve).sum() else np.ones(len(y), bool)
    bad = [t for t, m, z in zip(texts, trains, y, strict=True) if m and z]
    good = [t for t, m, z in zip(texts, trains, y, strict=True) if m and not z]
    bad, good = unlike(bad), unlike(good)
    ordinary = _content([w for t in good for w in windows(t)], DICT_BYTES)
    telling = telling_runs(bad, good)
    toxic = (
        _content([w for t in bad for w in windows(t)], TOXIC_BYTES, **SEGMENTS),
        _content([s for s in (_told(t, telling) for t in bad) if s.strip()], TOXIC_BYTES),
    )
    if not toxic[0]:
        return flat
    compressors = Model(ordinary, toxic, flat.thresholds, flat.weights).compressors()
    d = [distances(compressors, t) for t, m in zip(texts, for_curve, strict=True) if m]
    yc = y[for_curve]
    calm = np.hstack([np.zeros((2, 0)), *[x for x, z in zip(d, yc, strict=True) if not z]])
    calm = calm if calm.shape[1] else np.zeros((2, 1))
    thresholds = tuple(np.maximum(2.0, np.quantile(calm, 0.999, axis=1) + 1).tolist())
    x = np.array([features(v, thresholds) for v in d])
    sample = np.where(yc == 1, prior / max(yc.mean(), 1e-9), (1 - prior) / max(1 - yc.mean(), 1e-9))
    return Model(ordinary, toxic, thresholds, tuple(_logistic(x, yc, sample).tolist()))


def _place(doc_id) -> int:
    """Place of a document in the sample's order, from its id: a number or any other."""
    return doc_id * 2654435761 % 4294967291 if isinstance(doc_id, int) else zlib.crc32(str(doc_id).encode())


def fit_on(docs: DataFrame, labels: DataFrame, learns: Column, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """Fit on at most `rows` labelled documents of each class, of at most `chars`
    characters each. `learns` says which labels may be learned from. A doc_id with
    several labels counts as toxic if one of them is."""
    known = labels.where(learns & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    picked = known.where("toxic > 0").orderBy(*order).limit(rows).unionByName(known.where("toxic <= 0").orderBy(*order).limit(rows))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars))
    found = texts.join(F.broadcast(picked), texts["doc_id"] == picked["id"]).select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample = sorted(found.collect(), key=lambda r: (_place(r["id"]), r["text"]))
    return fit([r["text"] for r in sample], [r["toxic"] for r in sample], n.get(1, 0) / max(1, sum(n.values())))


def score(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1; a null text scores as an empty one."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        compressors, w = model.compressors(), np.array(model.weights)
        x = np.array([features(distances(compressors, t), model.thresholds) for t in texts]).reshape(-1, len(w))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a null doc_id is no such row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Every text is scored whole; null and empty texts and texts without words get the
    score of a document without telling windows. Null or missing labels are not
    learned from; without labels of both classes all scores are the share of toxic
    labels. Repeated rows score alike; an empty table gives an empty result. Only
    doc_id and text, and doc_id and toxic of `labels`, are read.
    """
    model = fit_on(docs, labels, ~held_out(F.col("doc_id")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents that are predicted toxic; columns as they are."""
    model = fit_on(docs, labels, ~held_out(F.col("doc_id")))
    return docs.where(score(F.col("text"), model) < 0.5)
