"""Registry of catalogue queries: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    _load()
    return {name: _prepared(fn) for name, fn in _QUERIES.items()}


def _prepared(fn: QueryFn) -> QueryFn:
    """Wrap a query so the session has a checkpoint folder and the workers
    can import the package before the plan is built."""
    import functools

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quarry.session import ensure_checkpoint_dir, ship_package
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    # importing the catalogue modules fills the registry
    from quarry.plans import (cat_text, cat_training, cat_responses,  # noqa: F401
                              cat_vectors, cat_metrics, cat_reports, cat_io)
