"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import shared, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _with(head: str, sql: str) -> str:
    """The SQL after common table expressions of its own and of `head`."""
    for start in ("with recursive ", "with "):
        if sql.lower().startswith(start):
            return f"{start}{head}, {sql[len(start):]}"
    return f"with {head} {sql}"


def query(sql: str | None = None, *ctes: str):
    """Registers a function under its name; `ctes` names views that the SQL reads."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            shared.ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            head = ", ".join(views.SQL[c] for c in ctes)
            ORACLE_SQL[f.__name__] = _with(head, sql.strip()) if head else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums in another order differ in their last bits; + 0.0 makes -0.0 plain."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["segment_combiners"](spark, sf_dir)


def load() -> None:
    from . import edge_queries, evaluation_queries, experiment_queries, extension_queries, family_queries, model_queries, range_queries, relational_queries, signal_queries, store_queries, stream_queries  # noqa: F401
