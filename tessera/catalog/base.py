"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """Views of one data directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bindings.view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, **more: str):
    """Registers a function of Views; ``sql`` over the same views is its oracle."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = bindings.oracle(sql, **more)
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six decimals, no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0
