"""Query registry: name -> Spark plan builder, and name -> DuckDB oracle SQL.

Names follow ``<group>_<operator>``. Each builder takes (spark, sf_dir) and
returns a lazy DataFrame over the whole supplied tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` (DuckDB text over the fixture views) makes
    it oracle-checked, None leaves it to the rows-only check."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return deco


def load_all() -> None:
    """Import every query module so their registrations run."""
    from . import q_alerts, q_features, q_merge, q_risk, q_routes, q_serving, q_streaming, q_trends  # noqa: F401
