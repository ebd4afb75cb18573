"""License scans by conditional compression (operator 9).

Candidate blocks are paragraphs (lines up to one without words) that hold a cue, a word
that licenses use. Around each cue, windows of about the templates' lengths are
compressed by themselves and with each template as a raw zstandard dictionary. A
template that saves a share of the bytes it saves of its own text is held against the
window word by word, and is confirmed if few words differ and none of them is a word
that tells licenses apart. All confirmed passages of a block are returned.
"""

from __future__ import annotations

import hashlib
import re
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices and passages of public licenses, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
)
#: Words that make another license of the same sentence.
TELLING = frozenset("mit apache gnu lesser affero general bsd clause mozilla cc by sa nc nd cc0 creative commons attribution".split())
#: In words with one space between, and in raw text.
CUE_WORDS = r"licen[sc]e|permission is hereby|redistribution and use|free software|public domain|\bcc0\b|\bcc by\b"
CUE = "(?i)" + CUE_WORDS.replace(" ", "[^a-zA-Z0-9]+")
#: Words on each side of a cue: a template is sought in the least that holds it.
REACH = (12, 24, 48, 96)
LEVEL = 19

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_CUE = re.compile(CUE_WORDS)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str):
    """(number, words) of the paragraphs that have a cue."""
    n, held = 0, []
    for line in [*text.split("\n"), ""]:
        w = words(line)
        if w:
            held += w
        elif held:
            if _CUE.search(" ".join(held)):
                yield n, held
            n, held = n + 1, []


def cues(block: list[str]) -> list[int]:
    """Places of the words at which a cue begins."""
    text, out, at, i = " ".join(block), [], 0, 0
    for m in _CUE.finditer(text):
        i += text.count(" ", at, m.start())
        at = m.start()
        out.append(i)
    return list(dict.fromkeys(out))


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.templates = [(name, words(t)) for name, t in templates]
        options = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(**options).compress
        self.given = []
        for _, w in self.templates:
            d = zstandard.ZstdCompressionDict(" ".join(["", *w, ""]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.given.append(zstandard.ZstdCompressor(dict_data=d, **options).compress)

        self.own = [len(self.alone(d)) - len(c(d)) for d, c in ((self._bytes(w), c) for (_, w), c in zip(self.templates, self.given, strict=True))]
        self.reach = [next((r for r in REACH if r >= len(w)), len(w)) for _, w in self.templates]

    @staticmethod
    def _bytes(w: list[str]) -> bytes:
        return " ".join(["", *w, ""]).encode()

    def saved(self, w: list[str], template: int) -> float:
        """Share of a passage that a template saves."""
        data = self._bytes(w)
        return 1 - len(self.given[template](data)) / len(self.alone(data))

    def differences(self, mine: list[str], template: int):
        """(first, last, missing, extra, telling) of the passage of `mine` that is
        nearest to a template: its place, template words that it lacks, words inside
        it that the template lacks, and whether one of either tells licenses apart.
        None if they share no word."""
        theirs = self.templates[template][1]
        core = SequenceMatcher(None, mine, theirs, autojunk=False).find_longest_match()
        if not core.size:
            return None
        slack = 2 + len(theirs) // 5
        low = max(0, core.a - core.b - slack)
        near = mine[low : core.a - core.b + len(theirs) + slack]
        parts = [m for m in SequenceMatcher(None, near, theirs, autojunk=False).get_matching_blocks() if m.size]
        # a common word farther off than it is long is none of the passage
        while len(parts) > 1 and parts[1].a - parts[0].a - parts[0].size > parts[0].size:
            parts = parts[1:]
        while len(parts) > 1 and parts[-1].a - parts[-2].a - parts[-2].size > parts[-1].size:
            parts = parts[:-1]
        first, last = parts[0].a, parts[-1].a + parts[-1].size
        used = {i for m in parts for i in range(m.a, m.a + m.size)}
        there = {i for m in parts for i in range(m.b, m.b + m.size)}
        extra = [near[i] for i in range(first, last) if i not in used]
        missing = [w for i, w in enumerate(theirs) if i not in there]
        telling = any(w in TELLING or w[:1].isdigit() or not w for w in [*extra, *missing])
        return low + first, low + last, len(missing), len(extra), telling

    def around(self, block: list[str], cue: int, least_own: float = 0.2, most_differing: float = 0.2):
        """Passages around a cue, the best first: (unconfirmed, telling, differing,
        -words, template, first, last, missing, extra)."""
        out, alone = [], {}
        for i, (reach, own) in enumerate(zip(self.reach, self.own, strict=True)):
            low = max(0, cue - reach)
            w = block[low : cue + reach + 1]
            data = self._bytes(w)
            if reach not in alone:
                alone[reach] = len(self.alone(data))
            if alone[reach] - len(self.given[i](data)) < least_own * own:
                continue
            found = self.differences(w, i)
            if found:
                first, last, missing, extra, telling = found
                size = len(self.templates[i][1])
                sure = not telling and missing + extra <= most_differing * size
                out.append((not sure, telling, missing + extra, missing - size, i, low + first, low + last, missing, extra))
        return sorted(out)

    def scan(self, block: list[str], least_saved: float = 0.15):
        """(name, share saved, missing, extra, confirmed) of all confirmed passages of
        a block, and of the best other passage at each cue outside them that a
        template saves enough of; in order of their places."""
        left, taken, rows, others = list(block), [False] * len(block), [], []
        for cue in cues(block):
            while not taken[cue]:
                found = self.around(left, cue)
                if not found or found[0][0]:
                    others += [(cue, x) for x in found if x[5] <= cue < x[6]][:1]
                    break
                rows.append((found[0], True))
                for at in range(found[0][5], found[0][6]):
                    left[at], taken[at] = "", True
        for cue, x in others:
            if not any(taken[x[5] : x[6]]) and not taken[cue]:
                rows.append((x, False))
                taken[x[5] : x[6]] = [True] * (x[6] - x[5])
        out = []
        for (_, _, _, _, i, first, last, missing, extra), sure in sorted(rows, key=lambda r: r[0][5]):
            saved = self.saved(block[first:last], i)
            if sure or saved >= least_saved:
                out.append((self.templates[i][0], saved, missing, extra, sure))
        return out


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("block", pa.int64()), ("license", pa.string()), ("saved", pa.float64()),
    ("n_missing", pa.int64()), ("n_extra", pa.int64()), ("confirmed", pa.bool_()),
])


def _scan(batches):
    scanner, known = Scanner(), {}
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for n, block in blocks(text):
                # blocks by digest: what is held is small whatever their length
                key = hashlib.blake2b("\n".join(block).encode(), digest_size=16).digest()
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = scanner.scan(block)
                rows += [(doc_id, n, *row) for row in known[key]]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, _SCHEMA, strict=True)], schema=_SCHEMA)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per passage that a template explains: doc_id, block (its paragraph's place
    in the text), license, saved, n_missing, n_extra, confirmed.

    Null and empty texts have no blocks; repeated rows and null doc_ids are scanned
    like others; passages whose best templates tie take the earlier one. Very long texts
    are scanned block by block, each around its cues. An empty table gives an empty result. Only doc_id and
    text are read; texts without a cue never leave the JVM.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CUE))
    return texts.mapInArrow(
        _scan, "doc_id long, block long, license string, saved double, n_missing long, n_extra long, confirmed boolean"
    )
