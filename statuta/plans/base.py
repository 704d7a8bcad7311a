"""How queries are registered: @query(sql) on a function of named tables."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers f(*tables): parameters are names of given or derived tables. sql: DuckDB's text for the
    same rows, with {name} for tables; None where SQL can't express it."""

    def register(f: Callable[..., DataFrame]) -> Callable:
        tables = list(inspect.signature(f).parameters)
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[fixtures.load(spark, sf_dir, t) for t in tables])
        if sql is not None:
            ORACLES[f.__name__] = fixtures.oracle(sql)
        return f

    return register
