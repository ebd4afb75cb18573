"""Registered queries of the operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import (
    decontaminate,
    fill_in_middle,
    hard_negatives,
    jaccard,
    language_model,
    licenses,
    line_quality,
    mixing,
    quality_classifier,
    secrets,
    token_counts,
    toxicity,
    url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_template_decontamination")
def op1(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_mix_sources", mixing.ORACLE.format(documents="documents"))
def op4(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op7_secret_ownership")
def op7(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op10_ngram_jaccard_join")
def op10(spark, sf_dir):
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@query("op3_compression_toxicity")
def op3(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_line_frequency_quality")
def op6(spark, sf_dir):
    return line_quality.judge_quality(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_gated_recurrent_lm")
def op5(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query("op2_redirect_equivalence", url_rules.ORACLE)
def op2(spark, sf_dir):
    return url_rules.filter_urls(table(spark, sf_dir, "pages"))


@query("op9_conditional_compression_licenses")
def op9(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op11_fill_in_middle", fill_in_middle.ORACLE)
def op11(spark, sf_dir):
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))


@query("op12_ngram_quality_classifier")
def op12(spark, sf_dir):
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_rtree_hard_negatives", hard_negatives.ORACLE)
def op13(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), relabel=label)
