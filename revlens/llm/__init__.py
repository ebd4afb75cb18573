"""Operators for large training-data pipelines, one module per operator.

Nothing outside this folder imports it; `queries.py` holds the registered
queries and their DuckDB oracles.
"""
