"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from bodygrid.session import broadcast_by_size, clean_shuffles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            broadcast_by_size(spark)
            clean_shuffles(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
