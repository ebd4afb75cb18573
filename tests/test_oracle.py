"""Registered queries vs their DuckDB oracle on the smallest benchmark tables."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SMOKE

KEYS = [
    "severity_kpi_secrets", "pr_stats", "chunk_pack", "secret_scan", "findings_parse", "dedupe_cross_reviewer",
    "verdict", "review_comment_render", "admission_route", "queue_depth_left_join", "function_metrics_left_join",
    "review_pipeline_batch",
]


@pytest.fixture(scope="module")
def con():
    from revlens.sources.driver import BASE_TABLES

    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    from revlens.plans.registry import load_all
    from tests.oracle_check import compare

    load_all()
    res = compare(spark, con, SMOKE, key)
    assert res["status"] == "OK", res
    assert res["rows"] > 0


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 1
    assert set(e.queries()) >= set(e.oracle_sql())
