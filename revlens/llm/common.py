"""Shared pieces: word splitting, stored intermediates, batch text hashing."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import checkpoint_dir

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder of ``spark.checkpoint.dir`` and
    read it back: the lineage is cut and every consumer sees the same rows, also
    after lost executors. The folder belongs to the application
    (``llm-<application id>``) and can go when the application is over."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            if "/llm-" in file:
                path.getFileSystem(conf).delete(path, True)


def released(spark) -> None:
    """Let Spark delete the shuffle files of finished steps now. It does so when the
    driver collects its garbage, which in a loop of few large steps is too late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast for a side of counted size; beyond `limit` rows Spark
    joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """Hint a shuffle join for a side that grows with the data. Spark would broadcast it by
    the size of its compressed files, and it may take ten times that of the driver's heap."""
    return df.hint("shuffle_merge")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- word hashes of whole texts, in numpy over an Arrow batch -------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed in one go (its arrays stay in the cache); a longer text is a go alone.
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if len(cache.get("p", ())) < n:
        p = np.full(max(n, _CHUNK + 1), _BASE, np.uint64)
        p[0] = 1
        cache["p"] = np.multiply.accumulate(p)
    return cache["p"][:n]


def word_bounds(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of bytes, where each word starts and ends in it, and
    each text's number of words."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], inside[:-1])))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return raw, start, end, np.diff(np.searchsorted(start, ends), prepend=0)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of `texts`, in order, and each text's number of
    words."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw, start, end, counts = word_bounds(texts, lower)
    return hashes_of(raw, start, end), counts


def hashes_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word's hash is a polynomial in its bytes, so it depends on the word alone;
    all words are handled by whole-array operations."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw)), out=sums[1:])
    # a word at byte i sums to base**i times its own polynomial: the base is odd,
    # so it has an inverse modulo 2**64, which takes the place out again
    inverse = _inverse_powers(len(raw))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _inverse_powers(n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if len(cache.get("p", ())) < n:
        p = np.full(max(n, _CHUNK + 1), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        p[0] = 1
        cache["p"] = np.multiply.accumulate(p)
    return cache["p"][:n]


def chunks(texts: list[bytes]):
    """(first, last) ranges of texts of bounded bytes together; one long text alone."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > _CHUNK:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def arrow_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null as empty."""
    import pyarrow as pa

    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]
