"""All queries over the supplied tables, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def wide(df: DataFrame) -> DataFrame:
    """``df`` with its int columns as bigint, as SQL counts."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name, with its DuckDB SQL where there is one."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return wide(f(spark, sf_dir))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return run

    return add


def _load() -> None:
    from lumenfold.plans import catalogue_queries, feed_queries, page_queries, signal_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
