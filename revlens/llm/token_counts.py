"""Token counts by rank-synchronous array merging (operator 8).

Pre-tokens of a batch lie one after another in one array of symbols. Each round finds
every sequence's pair of lowest rank and merges all its places in all sequences at
once; a sequence without a known pair leaves with its number of symbols. Counts of
pre-tokens already seen in a task are remembered, up to a bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies of this kind cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered in a task, and characters cut in one go.
REMEMBERED, GO = 400_000, 1 << 19
NONE = np.int64(1) << 40


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable ones
    for themselves, the others from code point 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Pair ranks of a vocabulary, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = np.int64(len(vocabulary) + 1)
        key = np.array([vocabulary[a] * int(self.size) + vocabulary[b] for a, b in merges], np.int64)
        new = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        order = order[np.concatenate(([True], key[order][1:] != key[order][:-1]))]
        self.keys, self.rank, self.new = key[order], order.astype(np.int64), new[order]
        symbol = byte_symbols()
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in symbol.items():
            self.of_byte[byte] = vocabulary[char]
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NONE where the pair has no merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.rank[at], NONE), self.new[at]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive all merges, of each word (none is empty)."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        rank, new = self._ranks(sym, seq, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            done = least == NONE
            if done.any():
                out[seq[first[done]]] = length[done]
                stay = np.repeat(~done, length)
                sym, seq, rank, new = sym[stay], seq[stay], rank[stay], new[stay]
                least, length = least[~done], length[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, length)
            # of overlapping places (a a a) every other one, from the left
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            sym[at] = new[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, seq, rank, new = sym[keep], seq[keep], rank[keep], new[keep]
            at = moved[at]
            fresh = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[fresh], new[fresh] = self._ranks(sym, seq, fresh)
        return out

    def _ranks(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs that begin at `at`; the last symbol of a sequence has none."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        then = np.minimum(at + 1, len(sym) - 1)
        rank, new = self.lookup(sym[at], sym[then])
        rank[(seq[at] != seq[then]) | (then == at)] = NONE
        return rank, new


@lru_cache(2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(1)
def _cutter():
    return regex.compile(PATTERN)


def _pieces(text: str, special) -> Iterator[tuple[list[str], int]]:
    """Pre-tokens of a text in lists of bounded length, with the number of special
    strings met before each."""
    parts = special.split(text) if special is not None else [text]
    for i, part in enumerate(parts):
        if len(part) <= GO:
            yield _cutter().findall(part), int(i > 0)
            continue
        found = (m.group() for m in _cutter().finditer(part))
        n = int(i > 0)
        while some := list(islice(found, 100_000)):
            yield some, n
            n = 0


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a text column; null is empty."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges, known = merges_of(path), {}

        def learn(waiting: list) -> None:
            missing = list({w for words in waiting for w in words if w not in known})
            if missing:
                known.update(zip(missing, merges.count([w.encode() for w in missing]).tolist(), strict=True))

        for texts in batches:
            out = np.zeros(len(texts), np.int64)
            waiting, owners, held = [], [], 0

            def settle():
                learn(waiting)
                for i, words in zip(owners, waiting, strict=True):
                    out[i] += sum(map(known.__getitem__, words))
                waiting.clear()
                owners.clear()
                if len(known) > REMEMBERED:
                    known.clear()

            for i, text in enumerate(texts):
                for words, special in _pieces(text or "", merges.special):
                    out[i] += special
                    waiting.append(words)
                    owners.append(i)
                    held += len(words)
                    if held > GO // 4:
                        settle()
                        held = 0
            settle()
            yield pd.Series(out)

    return run(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit.

    Whole texts are counted, special strings inside them as one token each; null and
    empty texts have 0 bytes and tokens. Null and repeated doc_ids pass through; an
    empty table gives an empty result. Only doc_id and text are read. `path` must be
    readable on every executor.
    """
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
