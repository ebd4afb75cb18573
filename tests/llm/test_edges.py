"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revlens.llm import decontaminate, jaccard, language_model, licenses, line_quality, mixing, secrets, token_counts, toxicity, url_rules

LONG = " ".join(f"word{i % 5000}" for i in range(60_000)) + " password=Xy12Zw34Qq56Rr"
ROWS = [
    (1, "a b c d e f g h", "en", "s1", 15), (2, "a b c d e f g h", "en", "s1", 15), (2, "a b c d e f g h", "en", "s1", 15),
    (3, None, None, None, None), (4, "", "en", "s2", 0), (5, " \t\n ", "en", "s2", 4), (None, "a b c d e f g h", None, "s1", None),
    (None, None, None, None, None), (6, LONG, "en", None, len(LONG)), (7, "one two", "en", "s2", 7), (8, "idiot token=Ab12Cd34Ef56Gh é", "en", "s2", 28),
    (9, "\U0001f600 éß \x00 �", "en", "s1", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("uid", "n", "class", "key", "h", "c", "v", "at", "size", "k", "r", "score", "label", "value", "host", "lines", "component_id", "word", "taken")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 1), (None, 1, 1), (3, None, None), (8, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (None, "x y z"), (4, "one two")], "item_id long, text string")


def tokens_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def operators(labels, benchmark):
    return {
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "mix": mixing.mix_sources,
        "lm": language_model.score_documents,
        "quality": line_quality.judge_quality,
        "secrets": secrets.scan_secrets,
        "tokens": lambda d: token_counts.count_tokens(d, tokens_path()),
        "jaccard": jaccard.similar_components,
    }


@pytest.mark.parametrize("name", ["toxicity", "mix", "lm", "quality", "secrets", "tokens", "jaccard"])
def test_one_row_per_row(docs, empty, labels, benchmark, name):
    op = operators(labels, benchmark)[name]
    rows = op(docs).collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((r[0] or 0) for r in ROWS)
    assert op(empty).collect() == []


def test_defined_values(docs, labels, benchmark):
    by = {r.doc_id: r for r in jaccard.similar_components(docs).collect() if r.doc_id is not None}
    assert by[2].component_id == 1 and by[3].component_id == 3 and by[3].n_shingles == 0 and by[7].n_shingles == 1
    nameless = [r for r in jaccard.similar_components(docs).collect() if r.doc_id is None]
    assert {(r.n_shingles, r.component_id) for r in nameless} == {(4, 1), (0, None)}
    by = {r.doc_id: r for r in token_counts.count_tokens(docs, tokens_path()).collect()}
    assert (by[3].n_bytes, by[3].n_tokens, by[6].over_limit) == (0, 0, True)
    by = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert by[3].size == 0 and by[3].taken == 0 and by[6].source_size == 60_001
    by = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    assert by[3].n_tokens == 1 and by[6].n_tokens == 60_002 and by[6].score < by[6].n_tokens * -1
    by = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert by[6].n_assign == 1 and by[8].n_assign == 1 and by[3].spans == ""
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert scores[3] == scores[4] == scores[5]


def test_contamination_edges(spark, docs, empty, benchmark):
    hits = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(1, 1), (2, 1), (None, 1), (7, 4)}
    assert decontaminate.contaminated(empty, benchmark).collect() == []
    assert decontaminate.contaminated(docs, benchmark.where("false")).collect() == []
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 5


def test_licenses_edges(docs, empty):
    assert licenses.scan_licenses(docs).collect() == [] and licenses.scan_licenses(empty).collect() == []


def test_urls_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "http://", ""), (None, "http://a.net/es/", None), (2, "://x.com/", "x" * 100_000), (2, "http://a.com?q", "")], "page_id long, url string, html string")
    pages = pages.select("*", F.lit(1).alias("uid"), F.lit(2).alias("host"), F.lit(3).alias("node"))
    rows = url_rules.filter_urls(pages).collect()
    assert len(rows) == 5 and {r.verdict for r in rows if r.page_id is None} == {"block"}
    assert [r.rule for r in rows if r.host == "a.com"] == [None]
    assert url_rules.filter_urls(pages.where("false")).collect() == []


def test_stages_keep_columns_and_clean_documents(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = [r.doc_id for r in out.collect()]
        assert {3, 4, 5, 6, 9} <= set(kept), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    copies = [r.doc_id for r in jaccard.one_of_each(docs).collect()]
    assert 2 not in copies and 1 in copies
    redacted = {r.doc_id: r for r in secrets.redact_live(docs).collect()}
    assert redacted[8].text == "idiot token=[secret] é" and redacted[8].n_chars == len("idiot token=[secret] é")
    assert redacted[1].text == "a b c d e f g h"


def test_pipeline_runs_whole(spark):
    """The pipeline's rows equal the stages' decisions, one by one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    from tests.llm import brute

    component = brute.jaccard_components(left)
    left = [(d, t) for d, t in left if component[d][1] == d]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(d, t) for d, t in left if not any(i in (t or "") for i in items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {d for d, _ in left}
    assert all(0 <= r.taken <= 2 * r.size for r in got.values())


def test_toxicity_of_text_ids(spark):
    """doc_ids that are no numbers."""
    docs = spark.createDataFrame([(f"d{i}", "you idiot and fool" if i % 3 == 0 else f"a calm word {i}") for i in range(60)], "doc_id string, text string")
    marked = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(60)], "doc_id string, toxic int")
    rows = toxicity.toxicity(docs, marked).collect()
    assert len(rows) == 60 and all(0 <= r.score <= 1 for r in rows)
