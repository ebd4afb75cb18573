"""Fill-in-middle against a plain version, and restoration from whole outputs."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from revlens.llm import fill_in_middle as fim
from revlens.llm import queries
from tests.conftest import SMOKE

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    n = len(u)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (n, form, len(p), len(m), sha(out), sha(text))


def rows_of(df):
    return sorted(
        ((r.doc_id is None, r.doc_id or 0), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256))
        for r in df.collect()
    )


EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "é ü ß  z \n"), (6, "has <P> inside of it"), (7, "w" * 300_000 + " x"),
    (8, "un deux trois " * 30_000), (9, "ab cd " * 5), (9, "ab cd " * 5), (None, "no id here at all"), (None, "no id here at all"),
    *[(i, f" one two\vthree {i} 日本 <M" + " four" * i) for i in range(10, 90)],
]


@pytest.fixture(scope="module")
def edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    return docs.select("*", F.lit(1).alias("uid"), F.lit("p").alias("pos"), F.lit(b"x").alias("piece"), F.lit(2).alias("form"), F.lit(3).alias("n"))


def test_edges_equal_plain_version(edges):
    want = sorted(((d is None, d or 0), plain(d, t)) for d, t in EDGES)
    assert rows_of(fim.fill_in_middle(edges)) == want
    assert {w[1][1] for w in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(edges.where("false")).collect() == []


def test_small_pieces(edges, monkeypatch):
    """Pieces of three units and seven bytes: the same digests."""
    monkeypatch.setattr(fim, "PIECE_UNITS", 3)
    monkeypatch.setattr(fim, "PIECE_BYTES", 7)
    some = edges.where("doc_id != 7 AND doc_id != 8")
    want = sorted(((d is None, d or 0), plain(d, t)) for d, t in EDGES if d is not None and d not in (7, 8))
    assert rows_of(fim.fill_in_middle(some)) == want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    want = sorted(((False, r.doc_id), plain(r.doc_id, r.text)) for r in docs.collect())
    assert rows_of(queries.QUERIES["op11_fill_in_middle"](spark, SMOKE)) == want


def test_outputs_restore(edges):
    outputs = fim.transformed(edges)
    texts = sorted(r[0] for r in outputs.select(fim.restored(F.col("output"), F.col("form")).alias("t")).collect())
    assert texts == sorted(t or "" for _, t in EDGES)
    assert all(r.output.count("<M>") == 1 for r in outputs.where("form != 'plain'").collect())


def test_pieces_are_bounded_and_dealt_by_document(edges):
    big = fim.pieces(edges).where("octet_length(piece) > 65536").count()
    dealt = fim.pieces(edges).select("uid", F.spark_partition_id().alias("task")).distinct()
    parts = dealt.groupBy("uid").count().where("count > 1").count()
    assert big == 0 and parts == 0


def test_one_exchange(edges):
    plan = fim.fill_in_middle(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fim.fill_in_middle(docs).collect()}
    assert got == {"a": plain("a", "x y z"), "b": plain("b", None)}
