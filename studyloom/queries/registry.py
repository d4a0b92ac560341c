"""Collects the registered queries of every module."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("memory", "review", "text", "web", "catalog", "narration", "ask", "study", "layout", "sources", "streaming", "markdown")


class Registry:
    """Queries of one module and the SQL each must equal."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return fn(spark, sf_dir)

            run.__doc__ = fn.__doc__
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def _registries() -> list[Registry]:
    return [importlib.import_module(f"studyloom.queries.{m}").R for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: v for r in _registries() for k, v in r.queries.items()}


def oracles() -> dict[str, str]:
    return {k: v for r in _registries() for k, v in r.sql.items()}
