"""Redaction by spans and rows; ownership by owners and repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.llm import secrets

SCHEMA = "doc_id long, text string, source string, n_chars long"
LIVE, OTHER = "Zq8Rk2LmN4pT7vWx", "Qw3Er5Ty7Ui9Op1A"


def redacted(spark, rows):
    docs = spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in rows], SCHEMA)
    docs = docs.select("*", F.lit(1).alias("uid"), F.lit(2).alias("row"), F.lit(3).alias("value"))
    out = secrets.redact_live(docs)
    assert out.columns == docs.columns
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or ""), r) for r in out.collect())


def test_value_inside_a_longer_word_stays(spark):
    got = redacted(spark, [
        (1, f"token={LIVE}", "a"), (2, f"see {LIVE} there", "b"), (3, f"see {LIVE}EXTRA there", "b"), (4, f"x{LIVE}y and {LIVE}", "b"),
    ])
    assert [r.text for _, r in got] == ["token=[secret]", "see [secret] there", f"see {LIVE}EXTRA there", f"x{LIVE}y and [secret]"]
    assert all(r.n_chars == len(r.text) for _, r in got)


def test_null_ids_are_rows_of_their_own(spark):
    rows = [(None, f"token={LIVE}", "a"), (None, f"say {OTHER}Z or {LIVE}Z", "a"), (None, f"password: {OTHER}", "b"), (None, None, None), (None, "plain", None)]
    got = sorted(r.text or "" for _, r in redacted(spark, rows))
    assert got == sorted(["token=[secret]", f"say {OTHER}Z or {LIVE}Z", "password: [secret]", "", "plain"])


def test_repeated_rows_and_many_spans(spark):
    text = " ".join(f"token={LIVE} é" for _ in range(50))
    got = redacted(spark, [(1, text, "a"), (1, text, "a"), (2, f"api_key='{OTHER}' token={OTHER}", "b")])
    want = " ".join("token=[secret] é" for _ in range(50))
    assert [r.text for _, r in got] == [want, want, "api_key='[secret]' token=[secret]"]


def test_examples_stay(spark):
    rows = [(i, f"token={LIVE}", f"s{i}") for i in range(4)] + [(9, f"token={OTHER}", "s1")]
    assert [r.text for _, r in redacted(spark, rows)] == [f"token={LIVE}"] * 4 + ["token=[secret]"]


def test_overlapping_spans_become_one(spark):
    df = spark.createDataFrame([("0123456789", [(2, 5), (4, 7), (7, 8)])], "t string, s array<struct<start:bigint,end:bigint>>")
    assert df.select(secrets.without(F.col("t"), F.col("s"), "#").alias("x")).first().x == "01##89"
    assert df.select(secrets.without(F.col("t"), F.slice("s", 1, 0), "#").alias("x")).first().x == "0123456789"


def test_repositories_and_owners_both_count(spark):
    """Few owners in very many repositories: an example; one owner in all of theirs: live."""
    rows = [(i, f"token={LIVE}", f"r{i}", f"o{i % 2}") for i in range(12)] + [(50 + i, f"token={OTHER}", f"q{i}", "p") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    got = secrets.scan_secrets(docs, F.col("repo"), F.col("owner")).collect()
    assert {(r.doc_id < 50, r.n_live, r.n_example) for r in got} == {(True, 0, 1), (False, 1, 0)}
