"""Plain Python versions of the operators' fixed parts."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def jaccard_components(rows):
    """{index: (n_shingles, component)} of (doc_id, text) rows with distinct ids."""
    sets = {}
    for d, text in rows:
        w = words(text)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = collections.defaultdict(list)
    for d in ids:
        for s in sets[d]:
            holders[s].append(d)
    for d in ids:
        shared = collections.Counter(e for s in sets[d] for e in holders[s] if e > d)
        for e, both in shared.items():
            if 100 * both >= 75 * (len(sets[d]) + len(sets[e]) - both):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text):
    """(n_assign, n_access, n_hex, sha256) of a text."""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m.group()) >= 24]
    found.sort()
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)
    n = [sum(x[1] == r for x in found) for r in range(3)]
    return (*n, hashlib.sha256(joined.encode()).hexdigest())


def quality_counts(text):
    text = text or ""
    w = words(text, lower=False)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
