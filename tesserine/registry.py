"""Query keys, their callables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``; ``oracle`` is DuckDB SQL over the same tables."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def load() -> None:
    """Import all modules that register queries."""
    from .plans import builders, code_flow, context, coverage, links, lookup, maintenance, records, statistics, templates, texts, traversals, vectors  # noqa: F401
