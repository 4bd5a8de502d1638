"""name -> (query, DuckDB SQL or None) for the operators of this library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated (spark, sf_dir) -> DataFrame under its own name."""

    def keep(f: Query) -> Query:
        _FOUND[name or f.__name__] = (f, sql)
        return f

    return keep


def _load() -> None:
    """The modules of queries register themselves when they are imported."""
    from tessera.plans import graph_queries, label_queries, layer_queries, metric_queries, table_queries, vector_queries  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["order_graph_embedding"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}
