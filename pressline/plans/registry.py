"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressline.plans.model import Model, model_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(model) -> DataFrame`` under ``name``, with its SQL when there is one."""

    def register(build: Callable[[Model], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Model(spark, folder))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = model_sql(sql)
        return build

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    import pressline.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"pressline.plans.{module.name}")
