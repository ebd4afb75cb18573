"""Registered queries: one per operator key, each with its DuckDB oracle.

Every query reads the benchmark tables of `sf_dir` (through the derived inputs
of `revlens.sources.driver`), runs the operator over all rows and returns a
DataFrame with plain column types. Nested results (arrays, maps) are flattened
to strings in the final projection only, so the oracle can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the query modules (each registers its keys on import)."""
    from revlens.plans import q_dashboard, q_findings, q_ingest, q_parse, q_score, q_stream  # noqa: F401
