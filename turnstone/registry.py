"""Collects the named queries of the engine's operator groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "w_context_windows"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql is the DuckDB text that must give the same rows, None where SQL can't express it."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    from importlib import import_module

    for name in ("context_queries", "scoring_queries", "text_queries", "audit_queries", "report_queries", "pass_queries", "whole_queries", "full_queries", "level_queries", "gate_queries"):
        import_module(f"turnstone.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
