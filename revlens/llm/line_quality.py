"""Quality rules with cross-document line frequency (operator 6).

One pass over the texts gives each document its counts and the hashes of its
normalised lines. Lines are counted by distinct documents per host; those above the
limit are taken out, and a document that loses too much of its words is depleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import arrow_texts, chunks, mix, stored, word_hashes

#: A line may stand in this many documents of a host; a document keeps at least this
#: share of its words.
LINE_DOCUMENTS, WORDS_LEFT = 20, 0.3
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Digits of a line count as one another, so that numbered lines are alike.
_DIGITS = bytes.maketrans(b"0123456789", b"0000000000")

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = (
    "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", lines array<struct<hash:long,words:int>>"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), *[(c, pa.int64()) for c in _COUNTS],
     ("lines", pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())])))]
)


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[ends], prepend=0)


def repeated_words(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the words in three-word windows that the text has twice or more."""
    ends = np.cumsum(counts)
    if len(w) < 3:
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[2:] == text[:-2]
    h = mix(w[:-2] + mix(w[1:-1] + np.uint64(1)) * np.uint64(3) + mix(w[2:] + np.uint64(2)) * np.uint64(5))
    h = mix(h + text[:-2].astype(np.uint64) * np.uint64(0x9E37_79B9_7F4A_7C15))
    at = np.flatnonzero(inside)
    _, which, n = np.unique(h[at], return_inverse=True, return_counts=True)
    at = at[n[which] > 1]
    covered = np.zeros(len(w), bool)
    for j in range(3):
        covered[at + j] = True
    return _per_text(covered, ends)


def line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line: case, spacing and digits do not count.
    A line without words has 0 words."""
    w, counts = word_hashes([x.translate(_DIGITS) for x in lines])
    if not len(w):
        return np.zeros(len(lines), np.uint64), counts
    start = np.cumsum(counts) - counts
    place = (np.arange(len(w)) - np.repeat(start, counts)).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(w + place * np.uint64(0x9E37_79B9_7F4A_7C15)), dtype=np.uint64)))
    return mix(total[start + counts] - total[start] + counts.astype(np.uint64)), counts


def _profile(batches):
    for batch in batches:
        texts = arrow_texts(batch.column("text"))
        columns = {c: [] for c in _COUNTS}
        hashes, words, sizes = [], [], []
        for first, last in chunks(texts):
            part = texts[first:last]
            w, counts = word_hashes(part, lower=False)
            raw = np.frombuffer(b"".join(part), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            solid = ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)))
            columns["n_words"] += counts.tolist()
            columns["word_chars"] += _per_text(solid & ((raw & 0xC0) != 0x80), ends).tolist()
            columns["n_symbols"] += _per_text(_SYMBOL[raw], ends).tolist()
            columns["n_repeat_words"] += repeated_words(w, counts).tolist()
            lines = [[x for x in t.split(b"\n") if x.strip(_SPACE_BYTES)] for t in part]
            columns["n_dup_lines"] += [len(x) - len(set(x)) for x in lines]
            h, n = line_hashes([x for one in lines for x in one])
            hashes.append(h.view(np.int64))
            words.append(n.astype(np.int32))
            sizes += [len(x) for x in lines]
        none = np.zeros(0, np.int64)
        structs = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(hashes or [none])), pa.array(np.concatenate(words or [none.astype(np.int32)]))], ["hash", "words"]
        )
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("host"), *[pa.array(columns[c], pa.int64()) for c in _COUNTS],
             pa.ListArray.from_arrays(offsets, structs)],
            schema=_ARROW,
        )


def judge_quality(
    docs: DataFrame, host: Column | None = None, documents: int = LINE_DOCUMENTS, left: float = WORDS_LEFT
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_removed_lines, n_left_words.

    `host` is the column whose documents count together (source by default; a null
    host is one of its own). A line above the limit is removed wherever it stands in
    that host; repeated rows of a doc_id count as one document, null doc_ids together
    as one. Null and empty texts have no words and fail. An empty table gives an
    empty result. Only doc_id, text and the columns inside `host` are read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.col("source") if host is None else host).cast("string").alias("host"), "text",
    )
    profile = stored(
        rows.mapInArrow(_profile, _SCHEMA).withColumn("uid", F.monotonically_increasing_id()), "line-profile"
    )
    lines = profile.select("uid", "doc_id", "host", F.inline("lines"))
    per_line = lines.groupBy("host", "hash", "doc_id").agg(F.lit(1).alias("one"))
    common = per_line.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > documents)
    common = common.select(F.col("host").alias("__host"), F.col("hash").alias("__hash"))
    out = lines.join(common, F.col("host").eqNullSafe(F.col("__host")) & (F.col("hash") == F.col("__hash")))
    removed = out.groupBy("uid").agg(F.count(F.lit(1)).alias("lines_out"), F.sum("words").alias("words_out"))
    judged = profile.drop("lines", "host").join(removed, "uid", "left")
    n_left = F.col("n_words") - F.coalesce("words_out", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return judged.select(
        "doc_id", *_COUNTS, failed.alias("base_failed"),
        (~failed & (n_left >= F.col("n_words") * left)).alias("kept"),
        F.coalesce("lines_out", F.lit(0)).cast("long").alias("n_removed_lines"), n_left.cast("long").alias("n_left_words"),
    )
