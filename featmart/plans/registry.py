"""Query registry: each catalogue entry is a Spark callable plus (optionally) a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featmart.plans.compare import normalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}   # same plans without the rounding


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; results are rounded for comparison."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return normalize(_fn(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        RAW[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
