"""Named queries over the stored tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.operators.measures import text_decimals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def shown(spark: SparkSession, directory: str) -> DataFrame:
            return text_decimals(query(spark, directory))

        QUERIES[name] = shown
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def load_all() -> None:
    from tallyline.plans import answer_checks, catalog_usage, filter_checks, log_checks, pricing_checks, replay_checks, store_checks, stored_checks  # noqa: F401
