"""Fill-in-middle transformation by secondary sort (operator 11).

A text is cut into units (white space and the word after it; white space at the end is a
unit of its own), and the units into prefix, middle and suffix at two hashed places. What
is written of a document are pieces of at most `PIECE_UNITS` units and `PIECE_BYTES`
bytes, keyed by document and place in the output. One exchange deals them by document and
sorts them by (document, place), the secondary sort of repartitionAndSortWithinPartitions
in its DataFrame form, so sorting spills and stays in the JVM; tasks then stream the pieces
in output order into a digest (or a text). For restoration the same pieces are sorted
again, inside their partitions, by the section that the sentinels before them name.
No task holds more than one piece of a document, however long it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import arrow_texts, chunks, word_bounds

SEED = "42"
PLAIN_PERCENT, SPM_PERCENT = 50, 80
#: Pieces of this many units, and of this many bytes, at most.
PIECE_UNITS, PIECE_BYTES = 1_024, 1 << 16
#: Sentinels, and the sections that they open, by their place in the text.
PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
_SECTION = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

_FACTS = "n long, form string, prefix_chars long, middle_chars long"
_FACT_TYPES = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def _hashes(doc_id: Column, seed: str) -> Column:
    """The first four 8-digit groups of the hex sha256 of `seed:doc_id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _cut(text: bytes, ends: np.ndarray, first: int, last: int) -> list[bytes]:
    """Units first to last of a text, as pieces."""
    at = [*range(first, last, PIECE_UNITS), last]
    out = []
    for a, b in zip(at, at[1:], strict=False):
        start, stop = int(ends[a - 1]) if a else 0, int(ends[b - 1]) if b else 0
        out += [text[i : min(i + PIECE_BYTES, stop)] for i in range(start, stop, PIECE_BYTES)]
    return out


def _code_points(part: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def _pieces_of(text: bytes, ends: np.ndarray, h: list[int], plain: int, spm: int) -> tuple[tuple, list[bytes]]:
    """(n, form, prefix_chars, middle_chars) of a text, and its pieces in output order."""
    n = len(ends)
    if not text or h[2] % 100 >= plain or any(s in text for s in _SECTION):
        return (n, "plain", None, None), _cut(text, ends, 0, n)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "spm" if h[3] % 100 < spm else "psm"
    start, stop = int(ends[a - 1]) if a else 0, int(ends[b - 1]) if b else 0
    units = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
    out = [p for s in _ORDER[form] for p in (s, *_cut(text, ends, *units[s]))]
    return (n, form, _code_points(text[:start]), _code_points(text[start:stop])), out


def unit_ends(texts: list[bytes]):
    """Of each text, where its units end."""
    for first, last in chunks(texts):
        part = texts[first:last]
        _, _, end, counts = word_bounds(part, lower=False)
        offset, at = 0, 0
        for text, k in zip(part, counts.tolist(), strict=True):
            ends = end[at : at + k] - offset
            if len(text) and (not k or ends[-1] < len(text)):
                ends = np.append(ends, len(text))
            yield ends
            offset, at = offset + len(text) + 1, at + k


def pieces(
    docs: DataFrame, seed: str = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """(uid, pos, doc_id, n, form, prefix_chars, middle_chars, piece): every document's
    output in pieces, dealt by document and sorted by place in it. The facts stand in a
    document's first row (pos 0)."""
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", _hashes(F.col("doc_id"), seed).alias("h"), F.col("text").cast("string").alias("text")
    )

    def emit(batches):
        for batch in batches:
            texts, ids = arrow_texts(batch.column("text")), batch.column("doc_id")
            out, size = [], 0
            for i, (uid, h, text, ends) in enumerate(
                zip(batch.column("uid").to_pylist(), batch.column("h").to_pylist(), texts, unit_ends(texts), strict=True)
            ):
                facts, parts = _pieces_of(text, ends, h, plain_percent, spm_percent)
                for pos, piece in enumerate(parts or [b""]):
                    out.append((uid, pos, i if pos == 0 else None, *(facts if pos == 0 else (None,) * 4), piece))
                    size += len(piece)
                    if size > 1 << 24:
                        yield _batch(out, ids)
                        out, size = [], 0
            if out:
                yield _batch(out, ids)

    dealt = rows.mapInArrow(emit, f"uid long, pos long, doc_id {id_type.simpleString()}, {_FACTS}, piece binary")
    return dealt.repartition("uid").sortWithinPartitions("uid", "pos")


def _batch(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
    uid, pos, at, n, form, prefix, middle, piece = zip(*rows, strict=True)
    arrays = [
        pa.array(uid, pa.int64()), pa.array(pos, pa.int64()), ids.take(pa.array(at, pa.int64())), pa.array(n, pa.int64()),
        pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(piece, pa.binary()),
    ]
    return pa.record_batch(arrays, names=["uid", "pos", "doc_id", *[f for f, _ in _FACT_TYPES], "piece"])


def _in_output_order(batches):
    """Streams sorted pieces into each document's digest of its output. Pieces come out
    with the section that the sentinel before them opened, the sentinels themselves
    don't; a document's last row has its facts and its digest, in section -1."""
    uid, facts, digest, section = None, None, None, 0

    def done():
        return (uid, -1, 0, *facts, digest.hexdigest(), None)

    for batch in batches:
        out, ids = [], batch.column("doc_id")
        columns = [batch.column(c).to_pylist() for c in ("uid", "pos", "n", "form", "prefix_chars", "middle_chars", "piece")]
        for i, (u, pos, n, form, prefix, middle, piece) in enumerate(zip(*columns, strict=True)):
            if u != uid:
                if uid is not None:
                    out.append(done())
                uid, digest, section = u, hashlib.sha256(), 0
                facts = (ids[i], n, form, prefix, middle)
            digest.update(piece)
            if facts[2] != "plain" and piece in _SECTION:
                section = _SECTION[piece]
            else:
                out.append((u, section, pos, None, None, None, None, None, None, piece))
        if out:
            yield _sections(out, ids.type)
        id_type = ids.type
    if uid is not None:
        yield _sections([done()], id_type)


def _sections(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    uid, section, pos, doc_id, n, form, prefix, middle, digest, piece = zip(*rows, strict=True)
    ids = pa.array([None if d is None else d.as_py() for d in doc_id], id_type)
    arrays = [
        pa.array(uid, pa.int64()), pa.array(section, pa.int32()), pa.array(pos, pa.int64()), ids, pa.array(n, pa.int64()),
        pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
        pa.array(digest, pa.string()), pa.array(piece, pa.binary()),
    ]
    return pa.record_batch(
        arrays, names=["uid", "section", "pos", "doc_id", *[f for f, _ in _FACT_TYPES], "output_sha256", "piece"]
    )


def _in_text_order(batches):
    """Streams pieces in the order of the text into the digest of the restored text."""
    uid, facts, digest = None, None, None
    names = ["doc_id", *[f for f, _ in _FACT_TYPES], "output_sha256"]
    id_type = None

    def rows(done):
        arrays = [pa.array([r[k] for r in done], t) for k, t in enumerate([id_type, *[t for _, t in _FACT_TYPES], pa.string(), pa.string()])]
        return pa.record_batch(arrays, names=[*names, "restored_sha256"])

    for batch in batches:
        done, id_type = [], batch.schema.field("doc_id").type
        uids, sections, texts = (batch.column(c).to_pylist() for c in ("uid", "section", "piece"))
        for i, (u, section, piece) in enumerate(zip(uids, sections, texts, strict=True)):
            if u != uid:
                if uid is not None:
                    done.append((*facts, digest.hexdigest()))
                uid, digest = u, hashlib.sha256()
            if section < 0:
                facts = tuple(batch.column(c)[i].as_py() for c in names)
            else:
                digest.update(piece)
        if done:
            yield rows(done)
    if uid is not None:
        yield rows([(*facts, digest.hexdigest())])


def fill_in_middle(
    docs: DataFrame, seed: str = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """One row per row of `docs`: doc_id, n, form, prefix_chars, middle_chars,
    output_sha256, restored_sha256.

    Null and empty texts have n 0, form plain and the digest of nothing; texts that hold
    a sentinel stay plain. A null doc_id is hashed as an empty one; repeated rows come
    out repeated. An empty table gives an empty result. Only doc_id and text are read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sections = pieces(docs, seed, plain_percent, spm_percent).mapInArrow(
        _in_output_order, f"uid long, section int, pos long, doc_id {id_type}, {_FACTS}, output_sha256 string, piece binary"
    )
    # the rows of a document are in one partition already: no second exchange
    return sections.sortWithinPartitions("uid", "section", "pos").mapInArrow(
        _in_text_order, f"doc_id {id_type}, {_FACTS}, output_sha256 string, restored_sha256 string"
    )


def transformed(
    docs: DataFrame, seed: str = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """(doc_id, form, output) of every document, as one text for training. Edge cases as
    in `fill_in_middle`; here a task holds the text of one document at a time."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def join(batches):
        uid, facts, parts, arrow_id = None, None, [], None

        def rows(done):
            ids, forms, texts = zip(*done, strict=True)
            return pa.record_batch(
                [pa.array(ids, arrow_id), pa.array(forms, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "form", "output"]
            )

        for batch in batches:
            arrow_id = batch.schema.field("doc_id").type
            for i, (u, form, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uid", "form", "piece")), strict=True)):
                if u != uid:
                    if uid is not None:
                        yield rows([(*facts, b"".join(parts).decode())])
                    uid, facts, parts = u, (batch.column("doc_id")[i].as_py(), form), []
                parts.append(piece)
        if uid is not None:
            yield rows([(*facts, b"".join(parts).decode())])

    return pieces(docs, seed, plain_percent, spm_percent).mapInArrow(join, f"doc_id {id_type}, form string, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))

    def between(first: str, then: str) -> Column:
        return F.regexp_extract(output, f"(?s){first}(.*?){then}", 1)

    middle = F.regexp_extract(output, f"(?s){m}(.*)\\z", 1)
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )


_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50
             THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""
