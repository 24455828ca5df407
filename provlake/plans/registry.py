"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..store import MetadataStore
from . import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, store: str = "a"):
    """Register a function of a store as a query. sql follows the store's tables: a SELECT, or a comma and more tables."""

    def register(f: Callable[[MetadataStore], DataFrame]) -> Callable[[MetadataStore], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(adapter.load(spark, sf_dir, store))
        if sql is not None:
            ORACLE[name] = f"{adapter.ctes(store)}\n{sql.strip()}"
        return f

    return register


def table_query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), and SQL over the driver's tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f

    return register
